"""Text tables as units, statements and tokens.

A unit is a row; a statement is a non-empty trimmed piece between sentence ends or line breaks, cut into runs of at most
``max_stmt_tokens`` tokens; tokens are runs of letters and digits in lower case, known by a content hash.  All is array
expressions over one row: no shuffle.  The score ``cc`` of a statement is its number of commas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.hashing import sql_token_id, token_id
from kindred.params import TEXT, CloneParams

STMT_END, NOT_TOKEN = r"[.!?\n]+", r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_TOKEN), lambda w: w != "")


def pieces(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, STMT_END), lambda s: F.trim(s)), lambda s: s != "")


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(unit_id, tokens): all token ids of a unit in order."""
    return docs.select(F.col(id_col).alias("unit_id"), F.transform(words(F.col(text_col)), token_id).alias("tokens"))


def units(docs: DataFrame, params: CloneParams = TEXT, id_col: str = "doc_id", text_col: str = "text", partition_col: str | None = "lang", folder_col: str | None = "source") -> DataFrame:
    """(unit_id, partition_key, folder, n_newlines, stmts): stmts is an array of (kind, tokens, text, cc), in order."""
    most = params.max_stmt_tokens

    def runs(x: Column) -> Column:
        first = F.sequence(F.lit(0), F.greatest(F.floor((F.size(x["own"]) - 1) / most), F.lit(0)).cast("int"))
        return F.transform(first, lambda i: F.struct(F.lit(0).alias("kind"), F.slice(x["ids"], i * most + 1, most).alias("tokens"), F.array_join(F.slice(x["own"], i * most + 1, most), " ").alias("text"), F.when(i == 0, x["commas"]).otherwise(0).alias("cc")))

    def worded(piece: Column) -> Column:
        """Each piece with its words and their ids, worked out once."""
        own = F.transform(piece, lambda s: F.struct(words(s).alias("own"), (F.length(s) - F.length(F.replace(s, F.lit(",")))).alias("commas")))
        return F.transform(own, lambda x: F.struct(x["own"].alias("own"), F.transform(x["own"], token_id).alias("ids"), x["commas"].alias("commas")))

    text = F.col(text_col)
    lit = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    return docs.where(text.isNotNull()).select(F.col(id_col).alias("unit_id"), lit(partition_col).alias("partition_key"), lit(folder_col).alias("folder"), F.regexp_count(text, F.lit("\n")).cast("bigint").alias("n_newlines"), F.flatten(F.transform(worded(pieces(text)), runs)).alias("stmts"))


def sized(units_df: DataFrame) -> DataFrame:
    """Units with their numbers of statements and tokens, and their score."""
    return units_df.withColumns({"n_stmts": F.size("stmts").cast("bigint"), "num_tokens": F.aggregate("stmts", F.lit(0), lambda a, s: a + F.size(s["tokens"])).cast("bigint"), "cc": F.aggregate("stmts", F.lit(0), lambda a, s: a + s["cc"]).cast("bigint")})


def large_enough(units_df: DataFrame, params: CloneParams = TEXT) -> DataFrame:
    return sized(units_df).where((F.col("n_stmts") >= params.min_stmts) & (F.col("num_tokens") >= params.min_tokens))


def statements(units_df: DataFrame) -> DataFrame:
    """One row per statement: unit_id, pos, kind, tokens, text, cc."""
    return units_df.select("unit_id", F.posexplode("stmts").alias("pos", "s")).select("unit_id", "pos", "s.kind", "s.tokens", "s.text", "s.cc")


# The same in DuckDB's SQL, for the oracle
def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{NOT_TOKEN}'), lambda w: w <> '')"


def sql_tokens(source: str = "documents", id_col: str = "doc_id") -> str:
    return f"SELECT {id_col} AS unit_id, list_transform({sql_words('text')}, lambda w: {sql_token_id('w')}) AS tokens FROM {source} WHERE text IS NOT NULL"


def sql_statements(most: int = TEXT.max_stmt_tokens) -> str:
    """unit_id, partition_key, folder, pos, n_tokens, text, cc."""
    return f"""SELECT unit_id, partition_key, folder, row_number() OVER (PARTITION BY unit_id ORDER BY i, k) - 1 AS pos, len(own) AS n_tokens, array_to_string(own, ' ') AS text, cc FROM (
  SELECT unit_id, partition_key, folder, i, k, w[k * {most} + 1 : (k + 1) * {most}] AS own, CASE WHEN k = 0 THEN length(s) - length(replace(s, ',', '')) ELSE 0 END AS cc FROM (
    SELECT *, unnest(range(0, greatest((len(w) - 1) // {most}, 0) + 1)) AS k FROM (
      SELECT *, {sql_words("s")} AS w FROM (
        SELECT doc_id AS unit_id, coalesce(lang, '') AS partition_key, coalesce(source, '') AS folder, unnest(p) AS s, unnest(range(1, len(p) + 1)) AS i FROM (
          SELECT *, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda s: trim(s)), lambda s: s <> '') AS p FROM documents WHERE text IS NOT NULL)))))"""
