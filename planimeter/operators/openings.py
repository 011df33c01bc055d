"""Doors and windows: gaps between the runs of a wall line, with edges read from its samples.

Lines are named by keys; points: keys, along, height; steps (returns off the wall plane): keys, along, depth. Samples of
one gap are gathered into sorted arrays (they lie within 0.8 m of it); what needs no order stays an aggregate."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planimeter.functions import arrays
from planimeter.functions.profiles import gathered, single_doors
from planimeter.functions.shared import stored
from planimeter.operators.lines import DENSE, SPARSE, aggregate_jambs, sparse_runs, support_runs

#: Width of a door or window, and by how much a 5 cm bin may miss it; shortest run beside it; reach of the samples.
NARROW, WIDE, BIN, FLANK, REACH = 0.68, 1.20, 0.05, 0.35, 0.80


def walking_band(points: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Points between 0.35 and 1.65 m of lines that have `least` of them; all points of other lines."""
    at = (F.col("height") > 0.35) & (F.col("height") < 1.65)
    enough = F.count_if(at).over(Window.partitionBy(*keys)) >= least
    return points.withColumns({"_at": at, "_enough": enough}).where(F.col("_at") | ~F.col("_enough")).drop("_at", "_enough")


def gaps_between(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps between neighbouring runs (a, b) that could be openings: keys, a, gap0, gap1, d."""
    after = Window.partitionBy(*keys).orderBy("a", "b")
    pairs = runs.select(*keys, "a", F.col("b").alias("gap0"), F.lead("a").over(after).alias("gap1"), F.lead("b").over(after).alias("d"))
    width = F.col("gap1") - F.col("gap0")
    flanked = (F.col("gap0") - F.col("a") >= FLANK) & (F.col("d") - F.col("gap1") >= FLANK)
    return pairs.where(flanked & (width >= NARROW - BIN) & (width <= WIDE + BIN))


def _strata(gap: str, low: Column, high: Column) -> list[Column]:
    """Counts by height of the points between low and high; all zero under five."""
    inside, h = F.col("along").between(low, high), F.col("height")
    n = F.count_if(inside)
    bands = {"low": (h > 0.15) & (h < 0.7), "mid": (h > 0.7) & (h < 1.5), "high": h >= 1.5}
    return [F.when(n < 5, 0).otherwise(F.count_if(inside & b)).alias(f"{gap}_{name}") for name, b in bands.items()]


def jambs(gaps: DataFrame, points: DataFrame, keys: list[str], steps: DataFrame | None = None) -> DataFrame:
    """gaps (keys, gap0, gap1 and others) with left, right and edge_sigma.

    An edge is the depth step beside it, if there is one; else half a pitch beyond the last station of the wall, if that
    is within 15 cm of the gap's bin. Gaps without three samples on both sides, without an edge, or whose edges come closer
    than 0.2 m keep the bins, with 2.5 cm."""
    c = F.col
    ids = [*keys, "gap0", "gap1"]
    mid = 0.5 * (c("gap0") + c("gap1"))
    near = gaps.select(*ids).distinct()
    x = c("along")
    # Points that were made by exploding look small to the planner: no side of these joins may be broadcast.
    reach = (x > c("gap0") - REACH) & (x < c("gap1") + REACH)
    samples = near.join(walking_band(points, keys, 6).hint("merge"), keys).where(reach).groupBy(*ids).agg(
        F.array_sort(F.collect_list(F.when((x < mid) & (x > c("gap0") - REACH), x))).alias("_l"),
        F.array_sort(F.collect_list(F.when((x > mid) & (x < c("gap1") + REACH), x))).alias("_r"),
    )
    if steps is None:
        off = near.withColumns({n: F.array().cast(arrays.DOUBLES) for n in ("_sl", "_sr")})
    else:
        deep = F.abs(c("depth")) >= 0.07
        off = near.join(steps.hint("merge"), keys, "left").groupBy(*ids).agg(
            F.array_sort(F.collect_list(F.when(deep & (x < mid + 0.05) & (x > c("gap0") - 0.20), x))).alias("_sl"),
            F.array_sort(F.collect_list(F.when(deep & (x > mid - 0.05) & (x < c("gap1") + 0.20), x))).alias("_sr"),
            F.count("along").alias("_n"),
        )
        off = off.withColumns({n: F.when(c("_n") >= 3, c(n)).otherwise(F.array().cast(arrays.DOUBLES)) for n in ("_sl", "_sr")}).drop("_n")
    both = samples.join(off.hint("merge"), ids).withColumn("_r", arrays.mirrored(c("_r"))).withColumn("_sr", arrays.mirrored(c("_sr")))
    both = stored(both).withColumns({"_step_l": arrays.reveal(c("_l"), c("_sl")), "_step_r": arrays.reveal(c("_r"), c("_sr"))})
    both = stored(both.withColumns({"_open_l": arrays.unobserved(c("_l")), "_open_r": arrays.unobserved(c("_r"))}))
    need = c("_step_l").isNull() | c("_step_r").isNull()
    lost = (F.size("_l") < 3) | (F.size("_r") < 3) | (need & (c("_open_l").isNull() | c("_open_r").isNull()))

    def edge(side: str, bin_edge: Column, sign: float) -> Column:
        open_edge = sign * c(f"_open_{side}.edge")
        return F.when(c(f"_step_{side}").isNotNull(), sign * c(f"_step_{side}")).when(F.abs(open_edge - bin_edge) <= 0.15, open_edge).otherwise(bin_edge)

    both = both.withColumns({"_edge_l": edge("l", c("gap0"), 1.0), "_edge_r": edge("r", c("gap1"), -1.0)})
    lost = lost | (c("_edge_r") - c("_edge_l") < 0.2)
    half = lambda side: F.when(c(f"_step_{side}").isNull(), c(f"_open_{side}.pitch")).otherwise(F.lit(0.02))
    sigma = F.when(~need, 0.01).otherwise(0.5 * F.greatest(half("l"), half("r")))
    found = both.select(
        *ids, F.when(lost, c("gap0")).otherwise(c("_edge_l")).alias("left"), F.when(lost, c("gap1")).otherwise(c("_edge_r")).alias("right"), F.when(lost, 0.025).otherwise(sigma).alias("edge_sigma")
    )
    out = gaps.join(found.hint("merge"), ids, "left")
    return out.withColumns({"left": F.coalesce("left", "gap0"), "right": F.coalesce("right", "gap1"), "edge_sigma": F.coalesce("edge_sigma", F.lit(0.025))})


def opening_candidates(points: DataFrame, keys: list[str], steps: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Gaps of lines that look like a door or a window, before those that overlap are told apart: keys, sparse, gap0,
    gap1, left, right, edge_sigma, kind, sill.

    Dense gaps lie between runs with three hits a bin (runs, if given), sparse ones between runs of one or two. A gap as
    full at mid height as a quarter of its flank is none, nor is a sparse one with three hits and a quarter of its
    flank's. The width between the edges lies from 0.68 to 1.20 m; that of a dense gap whose bins do so may miss it by two
    sigma, or 5 cm."""
    c = F.col
    strong = support_runs(walking_band(points, keys, 10), keys) if runs is None else runs
    thin = sparse_runs(walking_band(points, keys, 8), keys)
    pairs = gaps_between(strong, keys).withColumn("sparse", F.lit(False)).unionByName(gaps_between(thin, keys).withColumn("sparse", F.lit(True)))
    pairs = stored(pairs)
    ids = [*keys, "sparse", "a", "gap0", "gap1"]
    x = c("along")
    g = pairs.select(*ids).join(points.hint("merge"), keys).groupBy(*ids).agg(
        *_strata("gap", c("gap0"), c("gap1")), *_strata("flank", c("a"), c("gap0")),
        F.count_if((x > c("gap0") + 0.02) & (x < c("gap1") - 0.02)).alias("_hits"), F.count_if(x.between(c("a"), c("gap0"))).alias("_flank"),
    )
    full = (c("flank_mid") > 20) & (c("gap_mid") > 0.25 * c("flank_mid"))
    dotted = c("sparse") & (c("_hits") >= 3) & (c("_hits") > 0.25 * F.greatest(c("_flank"), F.lit(1)))
    found = jambs(stored(g.where(~full & ~dotted)), points, keys, steps)
    coarse, width = c("gap1") - c("gap0"), c("right") - c("left")
    fits = width.between(NARROW, WIDE)
    close = ~c("sparse") & coarse.between(NARROW, WIDE) & (F.abs(width - coarse) <= F.greatest(2 * c("edge_sigma"), F.lit(0.05)))
    window = (c("gap_low") > c("gap_mid")) & (c("gap_low") > 8) & (c("gap_high") > 8)
    found = found.where(fits | close).withColumns({"kind": F.when(window, "window").otherwise("door"), "sill": F.when(window, 0.85).otherwise(0.0)})
    return found.select(*ids, "left", "right", "edge_sigma", "kind", "sill")


def openings(points: DataFrame, spans: DataFrame, keys: list[str], steps: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Openings of each span (keys, its own columns, a0, a1, abs_floor) of a line, numbered in the order they were taken.

    Dense gaps come first, then sparse ones, each along the line; one that overlaps an opening taken before by over
    0.20 m is left out. method, confidence (0.80 dense, 0.52 sparse) and sigma come with each; heads are never seen."""
    own = [n for n in spans.columns if n not in keys]
    found = opening_candidates(points, keys, steps, runs)
    fields = ("sparse", "a", "gap0", "gap1", "left", "right", "edge_sigma", "kind", "sill")
    inside = (F.col("gap0") >= F.col("a0") - 0.05) & (F.col("gap1") <= F.col("a1") + 0.05)
    g = spans.join(found.hint("merge"), keys).where(inside).groupBy(*keys, *own).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("g"))

    def take(taken: Column, x: Column) -> Column:
        hides = F.exists(taken, lambda o: F.least(x["gap1"], o["right"]) - F.greatest(x["gap0"], o["left"]) > 0.20)
        return F.when(hides, taken).otherwise(F.concat(taken, F.array(x)))

    none = F.filter("g", lambda x: F.lit(False))
    o = g.select(*keys, *own, F.posexplode(F.aggregate("g", none, take)).alias("opening", "o"))
    sigma = F.greatest(F.col("o.edge_sigma"), F.lit(0.005), 0.5 * F.col("abs_floor"))
    return o.select(
        *keys, *own, "opening", F.col("o.kind").alias("kind"), (F.col("o.right") - F.col("o.left")).alias("width"), sigma.alias("sigma"), F.col("o.left").alias("along0"), F.col("o.right").alias("along1"),
        F.col("o.sill").alias("sill"), F.lit(None).cast("double").alias("head"), F.when(F.col("o.sparse"), SPARSE).otherwise(DENSE).alias("method"), F.when(F.col("o.sparse"), 0.52).otherwise(0.80).alias("confidence"),
    )


def frame_openings(profiles: DataFrame, keys: list[str], span: tuple[float, float] = (0.0, 4.0), abs_floor: float = 0.012) -> DataFrame:
    """The opening of each wall from its frames' profiles (keys, frame, along): frames of ten samples with exactly one
    door, taken together by aggregate_jambs()."""
    by = [*keys, "frame"]
    spark, kinds = profiles.sparkSession, {n: profiles.schema[n].dataType.simpleString() for n in by}
    known = " and ".join(f"`{k}` is not null" for k in by)
    p = profiles.where(known).select(*by, F.col("along").cast("double").alias("along"))
    named = ", ".join(f"`{n}` {t}" for n, t in kinds.items())
    # Samples of a line that come together travel as one array: each is read once and dealt out once.
    parts = p.mapInArrow(partial(gathered, value="along", items="_x", count="_n"), f"{named}, _x array<double>, _n bigint")
    dealt = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by)
    whole = dealt.groupBy(*by).agg(F.flatten(F.collect_list("_x")).alias("_x"), F.sum("_n").alias("_n")).where("_n >= 10").select(*by, "_x")
    doors = whole.mapInArrow(partial(single_doors, items="_x", span=span), f"{named}, left double, right double, sigma double, sparse boolean")
    sigma = F.greatest("sigma", F.lit(0.005), F.lit(0.5 * abs_floor))
    method = F.when(F.col("sparse"), SPARSE).otherwise(DENSE).alias("method")
    views = stored(doors.select(*keys, "left", "right", sigma.alias("half_left"), sigma.alias("half_right"), method))
    return aggregate_jambs(views, keys)
