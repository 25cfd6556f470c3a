"""Personal data: pattern seeds and bootstrapped contextual extraction, in DataFrame operations only.

Base kinds (email, ip, card, phone) are found by expressions and checked (parts to 255, Luhn and length, digit counts).  They
seed a graph.  Instances are the base spans as a whole, and candidates apart from them: tokens with a digit or an at sign, and
runs of adjacent tokens with digits; their contexts (the word to the left, the word to the right) are patterns.  A token of a
run is an instance too, but weighs nothing in a pattern's confidence, where its run stands for it.  A pattern's confidence for a kind is the mean score of its distinct instances, an instance's score is the best
confidence of the patterns it stands in; seeds count 1 for their kind.  Scores are propagated for ``ROUNDS`` rounds.  Candidates that
are no seed, but stand in a pattern of at least ``CONFIDENCE`` with at least ``SUPPORT`` distinct seeds, are unseen identifiers:
wherever they occur they become spans of kind ``<kind>_like``, the longest where one holds another.

Each text is scanned once; only candidates leave its row, and the graph is aggregated with partial sums, so neither a frequent
pattern nor a frequent instance is gathered anywhere.

Null and empty texts have no spans.  Each base kind is scanned from the left without overlap, failing matches drop without a
retry; offsets are in code points, end exclusive; spans are ordered by start, then kind as listed, the added kinds last.
Expressions use possessive loops, which neither recurse nor backtrack on very long texts.  Rows are
scanned one by one, whatever their ids (repeated, null); ties between kinds go to the kind listed first; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import materialise, table

KINDS = ("email", "ip", "card", "phone")
#: kind: (gate, expression).  The gate is a cheap condition without which nothing matches.
_LOCAL = "[A-Za-z0-9._%+-]"
EXPRESSIONS = {
    "email": ("@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("[0-9]\\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("[0-9][ -]?[0-9]", r"[0-9](?:[\x20-]?+[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
SPACE = r"[\x20\x09-\x0D]"
#: A whole token that holds a digit or an at sign.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
LEAST_LENGTH = 6
#: Matches of one text whose places are summed together.
RUN = 256
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.8, 5
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
TOKENS = "array<struct<from:int,to:int,start:int,value:string,word_before:string,word_after:string,digit:boolean,follows:boolean>>"
FOUND = "array<struct<start:int,value:string,left:string,right:string,part:boolean>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once; named inside a lambda, an expression would be worked out at every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def located(text: Column, expression: str) -> Column:
    """array<struct<start, end, value, before, after>> of the matches: what stands between them gives their places.

    Places are summed within runs of ``RUN`` matches first, then over the runs, as an array grows by being copied."""
    spans = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    none = lambda kind: F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))

    def span(x: Column, at: Column) -> Column:
        start = at + F.length(x["p"])
        return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("value"), x["p"].alias("before"), x["q"].alias("after"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["pos"] + F.length(x["p"]) + F.length(x["m"])).alias("pos"), F.concat(acc["out"], F.array(span(x, acc["pos"])).cast(spans)).alias("out"))

    def join(acc: Column, run: Column) -> Column:
        moved = F.transform(run["out"], lambda s: F.struct((s["start"] + acc["pos"]).alias("start"), (s["end"] + acc["pos"]).alias("end"), s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after")))
        return F.struct((acc["pos"] + run["pos"]).alias("pos"), F.concat(acc["out"], F.array(moved.cast(spans))).alias("out"))

    numbered = _once(
        F.struct(F.split(text, expression, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(expression), F.lit(0)).alias("matches")),
        lambda v: F.transform(v["matches"], lambda m, i: F.struct(m.alias("m"), F.get(v["pieces"], i).alias("p"), F.get(v["pieces"], i + 1).alias("q"))),
    )
    inner = f"struct<pos:int,out:{spans}>"
    outer = f"struct<pos:int,out:array<{spans}>>"
    runs = lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(RUN)), lambda i: F.aggregate(F.slice(v, i, F.lit(RUN)), none(spans).cast(inner), lambda acc, x: step(acc, x).cast(inner)))
    return F.aggregate(_once(numbered, runs), none(f"array<{spans}>").cast(outer), lambda acc, run: join(acc, run).cast(outer), lambda acc: F.flatten(acc["out"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    digits = F.transform(F.regexp_extract_all(F.reverse(value), F.lit("[0-9]"), F.lit(0)), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2))
    return F.aggregate(digits, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Base spans, ordered by start and kind."""
    def of(rank: int, kind: str) -> Column:
        gate, expression = EXPRESSIONS[kind]
        met = text.contains("@") if kind == "email" else text.rlike(gate)
        checked = F.filter(located(text, expression), lambda s: valid(kind, s["value"]))
        spans = F.transform(checked, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))
        return F.when(met, spans.cast(SPAN)).otherwise(F.array().cast(SPAN))

    out = [of(rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*out))


def tokens(text: Column) -> Column:
    """array<struct<from, to, start, value, word_before, word_after, digit, follows>>: tokens with a digit or @ (from, to), their value less
    outer punctuation, their contexts, and whether only blanks stand between the last such token and them."""
    shaped = F.transform(
        located(text, CANDIDATE),
        lambda s: F.struct(
            s["start"].alias("from"),
            s["end"].alias("to"),
            (s["start"] + F.length(F.regexp_extract(s["value"], r"^[^\p{L}\p{N}+]*+", 0))).alias("start"),
            F.regexp_replace(F.regexp_replace(s["value"], r"^[^\p{L}\p{N}+]*+", ""), r"[^\p{L}\p{N}]++$", "").alias("value"),
            F.lower(F.regexp_extract(s["before"], rf"([^\x20\x09-\x0D]++){SPACE}*+$", 1)).alias("word_before"),
            F.lower(F.regexp_extract(s["after"], rf"^{SPACE}*+([^\x20\x09-\x0D]++)", 1)).alias("word_after"),
            s["value"].rlike("[0-9]").alias("digit"),
            s["before"].rlike(r"^[\x20\x09]++$").alias("follows"),
        ),
    )
    return F.when(text.rlike("[0-9@]"), shaped)


def _free(t: Column) -> Column:
    return ~F.exists("base", lambda b: (b["start"] < t["to"]) & (b["end"] > t["from"]))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, base, seeds, found) of every row, ``row`` being a number of its own: base spans, these as instances, and candidates apart from them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"), base_spans(text).alias("base"), F.coalesce(tokens(text), F.array().cast(TOKENS)).alias("tokens"))
    # a base span begins and ends in tokens with a digit or @, which know the words around it
    seeds = F.transform(
        "base",
        lambda b: F.struct(
            b["value"].alias("value"),
            F.get(F.filter("tokens", lambda t: (t["from"] <= b["start"]) & (t["to"] > b["start"])), F.lit(0))["word_before"].alias("left"),
            F.get(F.filter("tokens", lambda t: (t["from"] < b["end"]) & (t["to"] >= b["end"])), F.lit(0))["word_after"].alias("right"),
            b["kind"].alias("kind"),
        ),
    )
    marked = F.transform("tokens", lambda t: t.withField("free", _free(t)))
    rows = rows.select("row", "id", "text", "base", seeds.alias("seeds"), marked.alias("tokens"))
    joins = lambda t, last: t["follows"] & t["digit"] & t["free"] & last["digit"] & last["free"]
    linked = F.transform("tokens", lambda t, i: F.when(i > 0, joins(t, F.get("tokens", i - 1))).otherwise(False))
    rows = rows.withColumn("linked", linked)
    first = F.filter(F.transform("linked", lambda x, i: F.when(~x, i)), lambda i: i.isNotNull())
    rows = rows.withColumn("first", first)
    last = lambda k: F.coalesce(F.get("first", k + 1), F.size("tokens")) - 1
    ends = F.transform("first", lambda i, k: F.struct(i.alias("i"), last(k).alias("j")))
    longer = F.transform(
        F.filter(ends, lambda e: e["j"] > e["i"]),
        lambda e: F.struct(F.get("tokens", e["i"])["start"].alias("start"), F.substring("text", F.get("tokens", e["i"])["start"] + 1, F.get("tokens", e["j"])["start"] + F.length(F.get("tokens", e["j"])["value"]) - F.get("tokens", e["i"])["start"]).alias("value"), F.get("tokens", e["i"])["word_before"].alias("left"), F.get("tokens", e["j"])["word_after"].alias("right"), F.lit(False).alias("part")),
    )
    own = F.transform("tokens", lambda t, i: F.struct(t["start"].alias("start"), t["value"].alias("value"), t["word_before"].alias("left"), t["word_after"].alias("right"), (F.get("linked", i) | F.coalesce(F.get("linked", i + 1), F.lit(False))).alias("part"), t["free"].alias("free")))
    single = F.transform(F.filter(own, lambda t: t["free"]), lambda t: t.dropFields("free"))
    found = F.filter(F.concat(single.cast(FOUND), longer.cast(FOUND)), lambda c: F.length(c["value"]) >= LEAST_LENGTH)
    return rows.select("row", "id", "base", "seeds", found.alias("found"))


def unseen(rows: DataFrame) -> DataFrame:
    """(value, kind) of the identifiers that contexts give away; rows as of ``scanned``."""
    seeds = rows.select(F.explode("seeds").alias("c")).select("c.value", "c.left", "c.right", "c.kind", F.lit(False).alias("part"))
    exploded = seeds.unionByName(rows.select(F.explode("found").alias("c")).select("c.value", "c.left", "c.right", F.lit(None).cast("string").alias("kind"), "c.part"))
    sides = F.explode(F.array(F.concat(F.lit("< "), "left"), F.concat(F.lit("> "), "right")))
    edges = exploded.select("value", "kind", "part", sides.alias("pattern")).where(F.length("pattern") > 2)
    edges = materialise(edges.groupBy("pattern", "value").agg(F.min("kind").alias("kind"), F.bool_and("part").alias("part")), "contexts")
    marked = edges.groupBy("value").agg(F.min("kind").alias("kind"))
    score = marked.where("kind is not null").select("value", "kind", F.lit(1.0).alias("score"), F.lit(True).alias("seed"))
    size = edges.where("not part").groupBy("pattern").agg(F.count("*").alias("size"))
    fresh = marked.where("kind is null").select("value")
    for _ in range(ROUNDS):
        sums = edges.where("not part").select("pattern", "value").join(score, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count_if("seed").alias("support"))
        sure = sums.join(size, "pattern").select("pattern", "kind", (F.col("s") / F.col("size")).alias("confidence"), "support").where(F.col("support") >= SUPPORT)
        best = edges.join(fresh, "value").select("pattern", "value").join(sure, "pattern").groupBy("value", "kind").agg(F.max("confidence").alias("score"))
        score = materialise(score.where("seed").unionByName(best.select("value", "kind", "score", F.lit(False).alias("seed"))), "scores")
    ranked = F.max_by(F.struct("kind", "score"), F.struct("score", F.array_position(F.array(*map(F.lit, reversed(KINDS))), F.col("kind"))))
    return score.where("not seed").groupBy("value").agg(ranked.alias("k")).where(F.col("k.score") >= CONFIDENCE).select("value", F.col("k.kind").alias("kind"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base and spans (arrays of start, rank, end, kind, value)."""
    rows = materialise(scanned(docs, id_col, text_col), "scanned")
    known = unseen(rows)
    exploded = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("c")).select("row", F.col("c.start").alias("start"), F.col("c.value").alias("value"))
    rank = F.lit(len(KINDS)) + F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    new = exploded.join(known, "value").select("row", F.struct("start", rank.cast("int").alias("rank"), (F.col("start") + F.length("value")).cast("int").alias("end"), F.concat("kind", F.lit("_like")).alias("kind"), "value").alias("span"))
    by_row = new.groupBy("row").agg(F.collect_set("span").cast(SPAN).alias("more"))
    outer = F.filter("more", lambda m: ~F.exists("more", lambda o: (o["start"] <= m["start"]) & (o["end"] >= m["end"]) & (o["end"] - o["start"] > m["end"] - m["start"])))
    joined = rows.select("row", "id", "base").join(by_row.withColumn("more", outer), "row", "left")
    apart = F.filter(F.coalesce("more", F.array().cast(SPAN)), lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"])))
    return joined.select("id", "base", F.array_sort(F.concat("base", apart)).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *map(count, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
