"""Peaks, runs and openings along lines. Keys are lists of columns that name a line of a capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How the end of a wall beside an opening was found.
DENSE, SPARSE = "wall_termination", "sparse_wall_termination"


def _dense(counts: DataFrame, keys: list[str], last: Column) -> DataFrame:
    """One row for each bin from 0 to last, with c (0 where nothing was counted)."""
    grid = counts.groupBy(*keys).agg(last.alias("_last")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("bin"))
    return grid.join(counts.select(*keys, "bin", "c"), [*keys, "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)).cast("long"))


def wall_peaks(values: DataFrame, keys: list[str], *, width: float = 0.02, share: float = 0.22, least: int = 15) -> DataFrame:
    """Peaks of a smoothed histogram of value: bins of `width` from p0.5 to p99.5, weights 1 2 3 2 1, no lower
    than either neighbour (end bins count), `share` of the top and `least` values. Groups under 30 values or
    narrower than 0.4 have none."""
    base = values.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(0.005), F.lit(0.995))).alias("_q"), F.count(F.lit(1)).alias("_n"))
    base = base.where((F.col("_n") >= 30) & (F.col("_q")[1] - F.col("_q")[0] >= 0.4)).select(*keys, F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))
    # Bins start at lo + i * width while that is under hi + width.
    base = base.withColumn("bins", F.ceil((F.col("hi") + width - F.col("lo")) / width - 1e-9).cast("long") - 1)
    rows = values.join(base, keys).where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("lo") + F.col("bins") * width))
    at = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.col("bins") - 1)
    counts = rows.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.first("bins").alias("bins"))
    dense = _dense(counts, keys, F.first("bins") - 1).join(base.select(*keys, "lo"), keys)
    along = Window.partitionBy(*keys).orderBy("bin")
    near = lambda k: F.coalesce(F.lag("c", k).over(along) if k > 0 else F.lead("c", -k).over(along) if k < 0 else F.col("c"), F.lit(0))
    smooth = (near(2) + 2 * near(1) + 3 * near(0) + 2 * near(-1) + near(-2)) / 9.0
    s = dense.withColumn("s", smooth).withColumns({"top": F.max("s").over(Window.partitionBy(*keys)), "left": F.lag("s").over(along), "right": F.lead("s").over(along)})
    s = s.where((F.col("s") >= F.coalesce("left", F.lit(-1.0))) & (F.col("s") >= F.coalesce("right", F.lit(-1.0))) & (F.col("s") >= share * F.col("top")) & (F.col("c") >= least))
    bend = F.col("left") - 2 * F.col("s") + F.col("right")
    shift = F.when(bend.isNull() | (F.abs(bend) < 1e-6), F.lit(0.0)).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("left") - F.col("right")) / bend)))
    return s.select(*keys, (F.col("lo") + (F.col("bin") + 0.5 + shift) * width).alias("pos"), F.col("s").alias("score"), F.col("c").alias("n"))


def merge_peaks(peaks: DataFrame, keys: list[str], gap: float = 0.32, closed: bool = True) -> DataFrame:
    """Peaks in order of position; one within `gap` of the last kept replaces it if its score is higher.

    closed: a peak at exactly the gap is within it. The last kept moves, so this is a fold, not islands; a line
    has some dozens of peaks."""
    def step(acc: Column, p: Column) -> Column:
        apart = F.abs(p["pos"] - F.try_element_at(acc, F.lit(-1))["pos"])
        far = (F.size(acc) == 0) | ((apart > gap) if closed else (apart >= gap))
        better = p["score"] > F.try_element_at(acc, F.lit(-1))["score"]
        return F.when(far, F.concat(acc, F.array(p))).when(better, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(p))).otherwise(acc)

    listed = peaks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "score", "n"))).alias("p"))
    empty = F.expr("cast(array() as array<struct<pos:double,score:double,n:bigint>>)")
    return listed.select(*keys, F.explode(F.aggregate("p", empty, step)).alias("p")).select(*keys, "p.*")


def _binned(values: DataFrame, keys: list[str], width: float, least: int) -> DataFrame:
    """keys, lo, bin, c of the bins that hold values, of lines with `least` values. Nothing is joined, so that lines are dealt
    once and no side can be taken for small."""
    line = Window.partitionBy(*keys)
    known = " and ".join(f"`{k}` is not null" for k in keys)
    v = values.where(known).withColumns({"lo": F.min("along").over(line), "_n": F.count(F.lit(1)).over(line)}).where(F.col("_n") >= least)
    counts = v.groupBy(*keys, "lo", F.floor((F.col("along") - F.col("lo")) / width).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return counts.where("bin is not null")


def _spans(runs: DataFrame, keys: list[str], width: float, shortest: float) -> DataFrame:
    """a, b, n of runs (first, last, lo, n) that are long enough."""
    out = runs.select(*keys, (F.col("lo") + F.col("first") * width).alias("a"), (F.col("lo") + (F.col("last") + 1) * width).alias("b"), "n")
    return out.where(F.col("b") - F.col("a") >= shortest - 1e-9)


def support_runs(values: DataFrame, keys: list[str], *, width: float = 0.05, hits: int = 3, hole: int = 5, shortest: float = 0.45) -> DataFrame:
    """Stretches a to b of a line with support: bins with 3 hits, interior holes of up to 5 bins filled, 0.45 or longer;
    lines under 10 points have none."""
    along = Window.partitionBy(*keys).orderBy("bin")
    # Running counts tell what lies between a run's ends.
    on = _binned(values, keys, width, 10).withColumn("_t", F.sum("c").over(along.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("c") >= hits)
    gap = F.col("bin") - F.lag("bin").over(along) - 1
    on = on.withColumn("_new", F.coalesce((gap > hole).cast("int"), F.lit(1))).withColumn("_id", F.sum("_new").over(along))
    ends = {"first": F.min("bin"), "last": F.max("bin"), "lo": F.first("lo"), "n": F.max("_t") - F.min(F.col("_t") - F.col("c"))}
    return _spans(on.groupBy(*keys, "_id").agg(*[v.alias(n) for n, v in ends.items()]), keys, width, shortest)


def sparse_runs(values: DataFrame, keys: list[str], *, width: float = 0.05, shortest: float = 0.45) -> DataFrame:
    """Stretches of bins with two hits, or one beside a bin that has any; nothing is filled; under 8 points: none."""
    along = Window.partitionBy(*keys).orderBy("bin")
    beside = F.coalesce(F.lag("bin").over(along) == F.col("bin") - 1, F.lit(False)) | F.coalesce(F.lead("bin").over(along) == F.col("bin") + 1, F.lit(False))
    on = _binned(values, keys, width, 8).withColumn("_beside", beside).where((F.col("c") >= 2) | ((F.col("c") == 1) & F.col("_beside")))
    on = on.withColumn("_g", F.col("bin") - F.row_number().over(along))
    return _spans(on.groupBy(*keys, "_g").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.first("lo").alias("lo"), F.sum("c").alias("n")), keys, width, shortest)


def station_centres(values: DataFrame, keys: list[str]) -> DataFrame:
    """Stations of each line: keys, station, centre, n.

    Lines of under three values have each as a station; of under three gaps over 0.1 mm one station, the median. Where
    the 95th percentile of those gaps is over max(0.02, 4 x their median), values are split at gaps of half of it or
    more and each part gives its median; else each value is a station."""
    along = Window.partitionBy(*keys).orderBy("along")
    gaps = values.select(*keys, "along").withColumn("gap", F.col("along") - F.lag("along").over(along))
    wide = F.when(F.col("gap") > 1e-4, F.col("gap"))
    cuts = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count(wide).alias("_wide"), F.percentile(wide, 0.95).alias("p95"), F.percentile(wide, 0.5).alias("mid"))
    split = F.col("p95") > F.greatest(F.lit(0.02), 4 * F.col("mid"))
    new = (
        F.when(F.col("gap").isNull() | (F.col("_n") < 3), 1).when(F.col("_wide") < 3, 0)
        .when(split, (F.col("gap") >= 0.5 * F.col("p95")).cast("int")).otherwise(1)
    )
    # Of equal values the one with the gap comes first, as it did there.
    order = Window.partitionBy(*keys).orderBy("along", F.col("gap").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    numbered = gaps.join(cuts, keys).withColumn("_new", new).withColumn("station", F.sum("_new").over(order))
    return numbered.groupBy(*keys, "station").agg(F.percentile("along", 0.5).alias("centre"), F.count(F.lit(1)).alias("n"))


def local_pitch(values: DataFrame, keys: list[str]) -> DataFrame:
    """Median spacing of neighbouring stations among those between 0.0001 and 0.15; 0.02 where there is none, or under
    three stations."""
    along = Window.partitionBy(*keys).orderBy("centre")
    d = station_centres(values, keys).withColumn("_d", F.col("centre") - F.lag("centre").over(along))
    near = F.percentile(F.when((F.col("_d") > 1e-4) & (F.col("_d") < 0.15), F.col("_d")), 0.5)
    return d.groupBy(*keys).agg(F.coalesce(F.when(F.count(F.lit(1)) >= 3, near), F.lit(0.02)).alias("pitch"))


def interval_centre(brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Centre of the overlap of brackets (lo, hi) that hold the median midpoint; the median itself where under two
    do or they do not overlap. met: the overlap was taken."""
    mid = (F.col("lo") + F.col("hi")) / 2
    med = brackets.groupBy(*keys).agg(F.percentile(mid, 0.5).alias("m"))
    kept = brackets.join(med, keys)
    holds = (F.col("lo") - 1e-9 <= F.col("m")) & (F.col("m") <= F.col("hi") + 1e-9)
    o = kept.groupBy(*keys).agg(F.first("m").alias("m"), F.count_if(holds).alias("n"), F.max(F.when(holds, F.col("lo"))).alias("lo"), F.min(F.when(holds, F.col("hi"))).alias("hi"))
    met = (F.col("n") >= 2) & (F.col("lo") - 1e-6 <= F.col("hi"))
    return o.select(*keys, F.when(met, (F.col("lo") + F.col("hi")) / 2).otherwise(F.col("m")).alias("centre"), "n", met.alias("met"))


def aggregate_jambs(views: DataFrame, keys: list[str]) -> DataFrame:
    """An opening from the edges that several views give it: left, right, width, method, frames, spread_m, confidence,
    localization.

    views: keys, left, right, half_left, half_right (half the interval in which an edge lies, or null), method. Where all
    views have halves each edge is the centre of the overlap of its intervals, else the median. spread_m is the median
    absolute deviation of the widths. Views that are all sparse stay under dense ones in confidence; one view alone has
    0.80 if it is a dense termination, else 0.45. Edges that cross give no opening."""
    ready = F.bool_and(F.col("half_left").isNotNull() & F.col("half_right").isNotNull())
    g = views.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), ready.alias("_ready"), F.percentile("left", 0.5).alias("_l"), F.percentile("right", 0.5).alias("_r"),
        F.percentile(F.col("right") - F.col("left"), 0.5).alias("_w"), F.bool_and(F.coalesce(F.col("method") == SPARSE, F.lit(False))).alias("_thin"), F.max("method").alias("_m"),
    )
    spread = views.join(g.select(*keys, "_w"), keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("right") - F.col("left") - F.col("_w")), 0.5).alias("_s"))
    for side in ("left", "right"):
        half = F.col(f"half_{side}")
        found = interval_centre(views.where(half.isNotNull()).select(*keys, (F.col(side) - half).alias("lo"), (F.col(side) + half).alias("hi")), keys)
        g = g.join(found.select(*keys, F.col("centre").alias(f"_{side}"), F.col("met").alias(f"_{side}_met")), keys, "left")
    g = g.join(spread, keys)
    edge = lambda side, plain: F.when(F.col("_ready"), F.col(f"_{side}")).otherwise(F.col(plain))
    g = g.withColumns({"left": edge("left", "_l"), "right": edge("right", "_r")}).where(F.col("right") > F.col("left"))
    one, dense = F.col("frames") == 1, F.col("_m") == DENSE
    method = F.when(F.col("_thin"), SPARSE).when(one & dense, DENSE).when(one, "single_frame_unobserved_interval").otherwise("multi_frame_wall_termination")
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    thin = clip(0.52 + 0.04 * (F.col("frames") - 1) - F.col("_s") / 0.06, 0.35, 0.62)
    sure = F.when(F.col("_thin"), thin).when(one & dense, 0.80).when(one, 0.45).otherwise(clip(1 - F.col("_s") / 0.06, 0.15, 0.95))
    met = F.col("_ready") & F.col("_left_met") & F.col("_right_met")
    return g.select(
        *keys, "left", "right", (F.col("right") - F.col("left")).alias("width"), method.alias("method"), "frames", F.round("_s", 4).alias("spread_m"), F.round(sure, 2).alias("confidence"),
        F.when(met, "interval_intersection").otherwise("median_midpoint").alias("localization"),
    )
