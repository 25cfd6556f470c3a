"""The engine: one method per question, over units from any source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import candidates, merge, rollup, sinks, sketch, verify, views
from kindred.operators.components import components
from kindred.params import TEXT, CloneParams
from kindred.sources import text
from kindred.storage import materialise, stored


@dataclass
class Clones:
    """Everything a clone search gives, as tables."""

    units: DataFrame
    pairs: DataFrame
    fragments: DataFrame
    spans: DataFrame
    clone_units: DataFrame
    global_units: DataFrame
    clones: DataFrame
    params: CloneParams

    def by_complexity(self) -> DataFrame:
        return rollup.clones_ranked(self.clones.drop("rank"), by_units=False)

    def counters(self) -> DataFrame:
        return rollup.counters(self.units, self.pairs, self.clones, self.params)

    def biggest(self) -> DataFrame:
        return rollup.biggest(self.clones, self.clone_units, self.units, self.params)

    def edges(self) -> DataFrame:
        return views.edges(self.clone_units, self.clones, self.unit_ranks())

    def unit_ranks(self) -> DataFrame:
        return rollup.ranked(self.global_units.select("unit_id", F.col("cc").alias("weight")), [F.asc("unit_id")])

    def labels(self) -> DataFrame:
        return views.labels(self.clones)

    def diff(self, rank: int | None = None) -> DataFrame:
        """Diff groups of all clones, or of the one of that rank, dearest first."""
        chosen = self.clones if rank is None else views.one_clone(self.clones, rank)
        own = self.clone_units.join(chosen.select("clone_id"), "clone_id", "left_semi")
        return views.diff_groups(own, self.units).orderBy(F.desc("cost"), "clone_id")


class CloneEngine:
    """Clone search with one set of parameters."""

    def __init__(self, spark: SparkSession, params: CloneParams = TEXT):
        self.spark, self.params = spark, params

    # sources
    def text_units(self, docs: DataFrame, **columns) -> DataFrame:
        return text.units(docs, self.params, **columns)

    def java_units(self, files: DataFrame, fixed: bool = True) -> DataFrame:
        from kindred.sources import java

        return java.units(files, self.params, fixed)

    # stages
    def unit_tokens(self, units: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        return units.select(*keys, "unit_id", F.flatten(F.transform("stmts", lambda s: s["tokens"])).alias("tokens"))

    def candidates(self, units: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        """Candidate pairs among units that are large enough (within ``keys`` where given)."""
        units = stored(units, "units")  # tokens are made once, not again by every condition on them
        tokens = self.unit_tokens(text.large_enough(units, self.params), keys)
        bands = materialise(sketch.bands(tokens.select("unit_id", "tokens"), self.params), "bands")
        if keys:
            bands = bands.join(units.select(*keys, "unit_id"), "unit_id")
        return candidates.candidates(bands, keys)

    def verified(self, units: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        units = stored(units, "units")
        return materialise(verify.verified(self.candidates(units, keys), units, self.params, keys), "verified")

    # the two pipelines
    def search(self, units: DataFrame, pairs: DataFrame | None = None) -> Clones:
        """Clone classes with their rollups, ranked.  ``pairs``: verified pairs from elsewhere."""
        units = stored(units, "units")
        pairs, frags = merge.merged(self.verified(units) if pairs is None else pairs, units, self.params)
        spans = materialise(rollup.unit_spans(pairs, frags), "spans")
        own = materialise(rollup.clone_units(spans, units), "clone-units")
        clones = rollup.with_max_cc(rollup.clone_rollup(pairs, frags), own)
        return Clones(units, pairs, frags, spans, own, rollup.global_units(spans, own, units), materialise(rollup.clones_ranked(clones), "ranked"), self.params)

    def export(self, units: DataFrame, path: str | None = None) -> DataFrame:
        """Verified pairs within each partition, as export rows; written as CSV where a path is given.  All partitions run at
        once, as the partition is part of every join's key."""
        units = stored(units, "units")
        pairs = self.verified(units, ("partition_key",))
        if path:
            sinks.write_pairs(pairs, units, path)
        return rollup.export_rows(pairs, units)

    def near_duplicates(self, docs: DataFrame, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
        """Near-duplicate classes by exact Jaccard of k-gram sets among candidates: class_id, n_units, n_links, max_sim, rank.

        Only one unit of each token sequence is compared; the others join its class."""
        tokens = materialise(text.tokens(docs, id_col).where(F.size("tokens") > 0), "tokens")
        reps = materialise(candidates.representatives(tokens), "representatives")
        own = tokens.join(reps.where("unit_id = rep_id").select("unit_id"), "unit_id", "left_semi")
        bands = sketch.bands(own, self.params)
        sets = sketch.shingles(own, self.params.shingle).select("unit_id", "shingles").where(F.size("shingles") > 0)
        links = materialise(candidates.jaccard(candidates.candidates(bands), sets).where(100 * F.col("n_both") >= percent * F.col("n_union")), "links")
        labels = components(links.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
        classes = reps.join(labels, F.col("rep_id") == F.col("vertex"), "left").select("unit_id", F.coalesce("component", "rep_id").alias("class_id"))
        sized = classes.groupBy("class_id").agg(F.count("*").alias("n_units")).where("n_units > 1")
        of = links.join(labels, F.col("left_id") == F.col("vertex")).groupBy("component").agg(F.count("*").alias("n_links"), F.max("sim").alias("max_sim"))
        out = sized.join(of, F.col("class_id") == F.col("component"), "left").select("class_id", "n_units", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("max_sim", F.lit(100)).cast("bigint").alias("max_sim"))
        return rollup.ranked(out, [F.desc("n_units"), F.asc("class_id")])
