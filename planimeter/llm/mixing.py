"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Each source gets a target number of words. Every document is first given as many certain whole copies
as its source's target holds whole source sizes. The rest is an unequal-probability sample: document i is
to be included with p = min(1, scale * (size / mean size) ** tempering), where scale makes the expected words of the
sample the words still needed (found exactly from the counts of each size; documents with p = 1 are certain
copies too). Pareto order sampling ranks documents by random odds divided by inclusion odds,
(u / (1 - u)) / (p / (1 - p)) with u in (0, 1) a hash of key and text, and takes them in that order until
the source's words come nearest its target, which fixes the sample's size in words.

The cut in that order is found without sorting a source: words are summed over 1024 ranges of the
ranking variable, then over 1024 ranges within the one the cut falls in, and only documents within the
last range, about a millionth of the source, are ordered. Sources are numbered by ranges of their names and
their targets found by rounds of sums, so no task holds all sources either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planimeter.llm.common import materialize, word_count

#: Ranges of the ranking variable at each of the two levels.
RANGES = 1024
#: Sources up to which the per-source plan is broadcast (about 150 bytes each).
BROADCAST_SOURCES = 50_000


def _rank(key: Column, text: Column, seed: int) -> Column:
    h = F.xxhash64(F.lit(seed), key, text)
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / F.lit(float(2**52))


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes with i, each source's place (from 0) in the order of names, null last."""
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sizes.repartitionByRange(parts, F.col("src").isNull(), F.col("src")).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt)  # a part's number must not change between its two uses
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a part
    counts = counts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.col("src").asc_nulls_last())) - 1
    return dealt.withColumn("nth", nth).join(F.broadcast(counts), "part").withColumn("i", F.col("ahead") + F.col("nth")).drop("part", "ahead", "nth")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Targets by source. sizes: src, source_size, n_docs; one row a source (null is a source, last).

    share times all words are divided by weight; a target stops at cap times its source's size and the
    excess goes to the others by weight until none is above. Each round is one sum over the sources: those whose
    cap lies under the level of the ones still free stop for good, which raises the level; a round without a new
    one ends it."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("i"), F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(_numbered(sizes).withColumn("w", w).withColumn("most", F.lit(float(cap)) * F.col("source_size")))
    level = 0.0
    budget = None
    while True:
        stops = F.col("most") < F.col("w") * F.lit(level)
        words, stopped, free = ranked.agg(F.sum("source_size"), F.sum(F.when(stops, F.col("most"))), F.sum(F.when(~stops, F.col("w")))).first()
        budget = float(share) * (words or 0) if budget is None else budget
        if not free:
            break
        higher = (budget - (stopped or 0.0)) / free
        if higher <= level:
            break
        level = higher
    target = F.least(F.col("most"), F.col("w") * F.lit(level))
    return ranked.select("src", "source_size", "n_docs", target.alias("target"))


def _keyed(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return df.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("src"),
        word_count(F.col(text_col)).alias("size"),
        _rank(F.col(id_col), F.col(text_col), seed).alias("u"),
    )


def _relative(tempering: float) -> Column:
    return F.pow(F.col("size") / F.col("mean_size"), F.lit(float(tempering)))


def _ranking(tempering: float) -> Column:
    """The Pareto variable (random odds over inclusion odds) q as q / (1 + q), which keeps its order; certain copies have 0."""
    p = F.least(F.lit(1.0), F.col("scale") * _relative(tempering))
    return F.col("u") * (1 - p) / (F.col("u") * (1 - p) + p * (1 - F.col("u")))


def _scales(keyed: DataFrame, plan: DataFrame, n_sources: int, tempering: float) -> DataFrame:
    """Per source the scale at which the expected words of the sample are the words needed, and the words needed
    beside the documents that are certain.

    With sizes from the largest down, those that are certain are a prefix: after each the scale of the others follows
    from sums of counts by size, and the first that makes none of them certain is right."""
    counts = keyed.where("size > 0").groupBy("src", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = _with_plan(counts, plan, n_sources).where("rest > 0")
    rows = rows.withColumn("w", _relative(tempering)).withColumn("words", F.col("n") * F.col("size"))
    larger = Window.partitionBy("src").orderBy(F.desc("w"), F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy("src").orderBy(F.desc("w"), F.desc("size")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("rest") - F.coalesce(F.sum("words").over(larger), F.lit(0))
    scaled = rows.withColumn("scale", left / F.sum(F.col("w") * F.col("words")).over(onward))
    scales = scaled.where("scale * w <= 1").groupBy("src").agg(F.max_by("scale", F.struct("w", "size")).alias("scale"))
    fixed = _with_plan(rows, materialize(scales), n_sources)
    return fixed.groupBy("src").agg(F.max("scale").alias("scale"), (F.max("rest") - F.sum(F.when(F.col("scale") * F.col("w") >= 1, F.col("words")).otherwise(0))).alias("need"))


def _with_plan(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    side = F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan
    return rows.join(side.withColumnRenamed("src", "plan_src"), F.col("src").eqNullSafe(F.col("plan_src")), "left").drop("plan_src")


def _range(part: Column) -> Column:
    return F.least(F.floor(part * RANGES), F.lit(RANGES - 1)).cast("int")


def mixing_plan(keyed: DataFrame, weights=(5, 2, 1), share=1.5, cap=2.0, tempering=0.5) -> tuple[DataFrame, int]:
    """Per source: size, target, whole copies and the cut of the sampled rest. keyed: see _keyed()."""
    sums = materialize(keyed.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    n_sources = sums.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = (
        source_targets(sums, weights, share, cap)
        .withColumn("whole", whole)
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("mean_size", F.col("source_size") / F.col("n_docs"))
    )
    plan = materialize(plan)
    plan = materialize(_with_plan(plan, _scales(keyed, plan, n_sources, tempering), n_sources).withColumn("scale", F.coalesce("scale", F.lit(1.0))))
    ranked = _with_plan(keyed.where("size > 0"), plan, n_sources).where("rest > 0").withColumn("v", _ranking(tempering)).where("v > 0")

    def crossing(part: DataFrame, by: str, need: str, name: str) -> DataFrame:
        """For each source the range its cut falls in, and what is still needed within it."""
        sums = part.groupBy("src", by).agg(F.sum("size").alias("s"), F.max(need).alias("need"))
        upto = Window.partitionBy("src").orderBy(by)
        cum = sums.withColumn("cum", F.sum("s").over(upto)).where(F.col("cum") >= F.col("need"))
        hit = cum.groupBy("src").agg(F.min_by(F.struct(F.col(by), (F.col("need") - F.col("cum") + F.col("s")).alias("left")), by).alias("x"))
        return hit.select("src", F.col(f"x.{by}").alias(name), F.col("x.left").alias(f"{name}_need"))

    first = ranked.withColumn("b1", _range(F.col("v")))
    level1 = materialize(crossing(first, "b1", "need", "cut1"))
    second = _with_plan(first, level1, n_sources).where("b1 = cut1").withColumn("b2", _range(F.col("v") * RANGES - F.col("b1")))
    level2 = materialize(crossing(second, "b2", "cut1_need", "cut2"))
    leaf = _with_plan(second, level2, n_sources).where("b2 = cut2")
    upto = Window.partitionBy("src").orderBy("v", F.col("doc_id").asc_nulls_first(), "u", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = leaf.withColumn("cum", F.sum("size").over(upto))
    taken = inside.where((F.col("cum") <= F.col("cut2_need")) | (F.col("cum") - F.col("cut2_need") < F.col("cut2_need") - F.col("cum") + F.col("size")))
    last = taken.groupBy("src").agg(F.max(F.struct(F.col("v").alias("v"), F.coalesce("doc_id", F.lit(-(2**63))).alias("d"))).alias("last"))
    for side in (level1, level2, last):
        plan = _with_plan(plan, side, n_sources)
    return materialize(plan), n_sources


def _decide(rows: DataFrame, tempering: float) -> DataFrame:
    b1 = _range(F.col("v"))
    b2 = _range(F.col("v") * RANGES - b1)
    key = F.struct(F.col("v").alias("v"), F.coalesce("doc_id", F.lit(-(2**63))).alias("d"))
    sampled = (
        (F.col("size") > 0)
        & (F.col("rest") > 0)
        & F.when((F.col("v") <= 0) | F.col("cut1").isNull(), F.lit(True))
        .when(b1 != F.col("cut1"), b1 < F.col("cut1"))
        .when(F.col("cut2").isNull(), F.lit(True))
        .when(b2 != F.col("cut2"), b2 < F.col("cut2"))
        .otherwise(F.coalesce(key <= F.col("last"), F.lit(False)))
    )
    return rows.withColumn("v", F.when(F.col("size") > 0, _ranking(tempering))).withColumn(
        "copies", F.when(F.col("size") > 0, F.col("whole") + F.coalesce(sampled, F.lit(False)).cast("long")).otherwise(F.lit(0))
    )


def mix_sources(
    df: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), share=1.5, cap=2.0, tempering=0.5, seed=8
) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, copies, src.

    size counts words (null or blank text: 0; such documents are never taken). A null source is a source
    of its own, ordered last. Rows alike in key and text share a ranking variable and stand or fall
    together; rows with a null key are told apart by their text. An empty table gives no rows. Other
    columns are not read, so their names cannot clash. Reruns agree: nothing depends on row order."""
    keyed = materialize(_keyed(df, id_col, text_col, source_col, seed))
    plan, n = mixing_plan(keyed, weights, share, cap, tempering)
    out = _decide(_with_plan(keyed, plan, n), tempering)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "src")


def mixed_documents(
    df: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), share=1.5, cap=2.0, tempering=0.5, seed=8
) -> DataFrame:
    """The mixed table itself: each row of df as often as the mix takes it, with df's columns only."""
    keyed = materialize(_keyed(df, id_col, text_col, source_col, seed))
    plan, n = mixing_plan(keyed, weights, share, cap, tempering)
    held = df.select(F.struct("*").alias("row"))
    rows = held.select(
        "row",
        F.col(f"row.{id_col}").alias("doc_id"),
        F.col(f"row.{source_col}").alias("src"),
        word_count(F.col(f"row.{text_col}")).alias("size"),
        _rank(F.col(f"row.{id_col}"), F.col(f"row.{text_col}"), seed).alias("u"),
    )
    out = _decide(_with_plan(rows, plan, n), tempering).where("copies > 0")
    return out.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
