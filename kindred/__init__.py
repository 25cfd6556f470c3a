"""kindred: a Spark-native engine that finds, classifies, groups and ranks duplicated content."""
