"""Gates by tier, checks of captures and bundles, and shaping around them. A missing side is a state, never a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planimeter.functions.expr import eligible_source, gate_status, hist_bin


def _within(limit: float) -> Column:
    """Relative error of a row at most limit; a missing length or a truth of 0 fails."""
    return F.coalesce(F.abs(F.col("predicted") - F.col("truth")) / F.nullif(F.abs(F.col("truth")), F.lit(0.0)) <= limit, F.lit(False))


def photo_gate(walls: DataFrame, footprints: DataFrame, keys: list[str], limit: float = 0.08) -> DataFrame:
    """status of each capture: every wall and the footprint within 8 %.

    walls: keys, predicted, truth. footprints: one row a capture with keys, predicted, truth, source, calibrated.
    No wall, no footprint truth, a source that is not physical or no calibration: BLOCKED."""
    w = walls.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_walls"), F.count_if(_within(limit)).alias("n_within"))
    known = F.coalesce(F.col("truth") != 0, F.lit(False)) & F.col("predicted").isNotNull()
    f = footprints.select(*keys, F.when(known, _within(limit)).alias("footprint_ok"), (eligible_source(F.col("source")) & F.coalesce("calibrated", F.lit(False))).alias("eligible"))
    out = f.join(w, keys, "left").na.fill(0, ["n_walls", "n_within"])
    passed = F.when((F.col("n_walls") > 0) & F.col("footprint_ok").isNotNull(), (F.col("n_walls") == F.col("n_within")) & F.col("footprint_ok"))
    return out.select(*keys, "n_walls", "n_within", "footprint_ok", gate_status(F.col("eligible"), passed).alias("status"))


def video_gate(plans: DataFrame, walls: DataFrame, keys: list[str], limit: float = 0.03) -> DataFrame:
    """status of each plan (keys, state, n_rooms, reasons, source): DEGRADED if it says so, has no rooms or no closed
    room; else every wall within 3 %; without walls or a physical source BLOCKED."""
    w = walls.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_walls"), F.count_if(_within(limit)).alias("n_within"))
    out = plans.join(w, keys, "left").na.fill(0, ["n_walls", "n_within"])
    reasons = F.coalesce("reasons", F.array().cast("array<string>"))
    degraded = F.coalesce(F.col("state") == "degraded", F.lit(False)) | (F.coalesce("n_rooms", F.lit(0)) == 0) | F.array_contains(reasons, "no_room_closure")
    passed = F.when(F.col("n_walls") > 0, F.col("n_walls") == F.col("n_within"))
    status = F.when(degraded, "DEGRADED").otherwise(gate_status(eligible_source(F.col("source")), passed))
    return out.select(*keys, "n_walls", "n_within", status.alias("status"))


def damage_gate(matched: DataFrame, keys: list[str]) -> DataFrame:
    """status from rank_match() rows with source and synthetic: no truth is missed and nothing is claimed beyond it.
    Without truth, with a source that is not physical, or on a synthetic scene: BLOCKED. mean_extent_error_m2 is that of
    matched rows with both extents (truth, predicted), where there are such columns."""
    miss, claim = F.col("predicted_id").isNull(), F.col("truth_id").isNull()
    g = matched.groupBy(*keys).agg(
        F.count("truth_id").alias("n_truth"), F.count_if(miss).alias("n_missed"), F.count_if(claim).alias("n_false"),
        F.bool_and(eligible_source(F.col("source")) & ~F.coalesce("synthetic", F.lit(False)) | claim).alias("eligible"),
    )
    passed = F.when(F.col("n_truth") > 0, (F.col("n_missed") == 0) & (F.col("n_false") == 0))
    out = g.select(*keys, "n_truth", "n_missed", "n_false", gate_status(F.col("eligible"), passed).alias("status"))
    if not {"truth", "predicted"} <= set(matched.columns):
        return out
    errors = matched.groupBy(*keys).agg(F.round(F.avg(F.abs(F.col("predicted") - F.col("truth"))), 4).alias("mean_extent_error_m2"))
    return out.join(errors, keys)


def repeat_rows(pairs: DataFrame, abs_limit: float = 0.01, rel_limit: float = 0.005) -> DataFrame:
    """pairs with first and second: within 1 cm, or within 0.5 % of the longer. Rows that lack a side are left out."""
    gap, longest = F.abs(F.col("first") - F.col("second")), F.greatest(F.abs("first"), F.abs("second"))
    rel = F.try_divide(gap, longest)
    return pairs.where("first is not null and second is not null").withColumns(
        {"abs_error": gap, "rel_error": rel, "passed": (gap <= abs_limit) | F.coalesce(rel <= rel_limit, F.lit(False))}
    )


def downgrade(gates: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """PASS and FAIL become BLOCKED where issues (keys) name the gate; other states stay."""
    named = issues.select(*keys).distinct().withColumn("_hit", F.lit(True))
    status = F.when(F.col("_hit") & F.col("status").isin("PASS", "FAIL"), "BLOCKED").otherwise(F.col("status"))
    return gates.join(named, keys, "left").withColumn("status", status).drop("_hit")


def first_failure(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Of a bundle's checks (priority, name, ok) the first that is not ok; status ok where there is none."""
    bad = F.when(~F.coalesce("ok", F.lit(False)), F.struct("priority", "name"))
    g = checks.groupBy(*keys).agg(F.min(bad).alias("b"))
    return g.select(*keys, F.coalesce("b.name", F.lit("ok")).alias("status"))


def time_steps(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames (ord, ts) of each capture: n, and how many come before the one ahead of them; equal times are in order."""
    w = Window.partitionBy(*keys).orderBy("ord")
    steps = frames.withColumn("_back", F.col("ts") < F.lag("ts").over(w))
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("_back").alias("n_back"))


def sample_frames(points: DataFrame, keys: list[str], most: int = 220) -> DataFrame:
    """Rows of every k-th frame, k the least stride that leaves at most `most` frames of a capture."""
    frames = points.select(*keys, "frame_index").distinct()
    w = Window.partitionBy(*keys).orderBy("frame_index")
    stride = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / F.lit(most))
    kept = frames.withColumns({"_at": F.row_number().over(w) - 1, "_by": stride}).where("_at % _by = 0")
    return points.join(kept.drop("_at", "_by"), [*keys, "frame_index"], "left_semi")


def height_profile(points: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Points (along, height) of each gap (a, b) by height: low, mid, high; all zero under five points."""
    h = F.col("height")
    inside = gaps.join(points, keys, "left").withColumn("height", F.when(F.col("along").between(F.col("a"), F.col("b")), h))
    strata = {"low": (h > 0.15) & (h < 0.7), "mid": (h > 0.7) & (h < 1.5), "high": h >= 1.5}
    g = inside.groupBy(*keys, "a", "b").agg(F.count("height").alias("n"), *[F.count_if(c).alias(n) for n, c in strata.items()])
    return g.select(*keys, "a", "b", "n", *[F.when(F.col("n") < 5, 0).otherwise(F.col(c)).alias(c) for c in strata])


def face_positions(points: DataFrame, lines: DataFrame, keys: list[str], base_sigma: float = 0.01, band: float = 0.11, least: int = 40) -> DataFrame:
    """Of each line (pos) with enough points (coord) near it the two faces: 12th and 88th percentile, or the median
    twice if they are under 6 cm apart; sigma is the points' spread, base_sigma at least."""
    near = lines.select(*keys, "pos").join(points, keys).where(F.abs(F.col("coord") - F.col("pos")) <= band)
    q = F.percentile("coord", F.array(F.lit(0.12), F.lit(0.5), F.lit(0.88)))
    g = near.groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.stddev_pop("coord").alias("s")).where(F.col("n") >= least)
    thin = F.col("q")[2] - F.col("q")[0] < 0.06
    face = lambda i: F.when(thin, F.col("q")[1]).otherwise(F.col("q")[i])
    return g.select(*keys, "pos", "n", face(0).alias("face_lo"), face(2).alias("face_hi"), F.greatest(F.lit(base_sigma), F.col("s")).alias("sigma"))


def ceiling_heights(heights: DataFrame, keys: list[str]) -> DataFrame:
    """Ceiling of each cell from its points' heights: the fullest 2 cm bin over 1.85 m, the median within 6 cm of it.
    Cells with under 80 high points, under 40 in the bin or the band, or a spread over 4 cm have none."""
    w = Window.partitionBy(*keys)
    high = heights.where("height > 1.85").withColumns({"_n": F.count(F.lit(1)).over(w), "_top": F.max("height").over(w)}).where("_n >= 80")
    edges = F.ceil((F.least(F.lit(4.2), F.col("_top") + 0.05) - 1.85) / 0.02)
    binned = high.withColumn("_bin", hist_bin(F.col("height"), F.lit(1.85), F.lit(0.02), edges - 1))
    counts = binned.where("_bin is not null").groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    mode = counts.groupBy(*keys).agg(F.max(F.struct("_c", (-F.col("_bin")).alias("b"))).alias("m")).where("m._c >= 40")
    centre = mode.select(*keys, (1.85 + (0.5 - F.col("m.b")) * 0.02).alias("_centre"))
    band = high.join(centre, keys).where(F.abs(F.col("height") - F.col("_centre")) < 0.06)
    g = band.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("height", 0.5).alias("ceiling"), F.stddev_pop("height").alias("_s"))
    return g.where("n >= 40 and _s <= 0.04").select(*keys, "n", "ceiling", (F.col("_s") + 0.005).alias("sigma"))


def match_rooms(predicted: DataFrame, truth: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Rooms of both sides by id, predicted ids going through names (keys, room_id, truth_id) where these know them."""
    known = predicted.join(names, [*keys, "room_id"], "left").select(*keys, F.coalesce("truth_id", "room_id").alias("_on"), F.col("room_id").alias("predicted_room"))
    there = truth.select(*keys, F.col("room_id").alias("_on"), F.col("room_id").alias("truth_room"))
    return there.join(known, [*keys, "_on"], "full_outer").drop("_on")


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], cap: float) -> DataFrame:
    """For each left point (id, x, z) the nearest right one under cap metres, the smaller id on ties; else null.

    Points meet in squares of cap metres, so each is held against its own and eight others."""
    square = lambda c: F.floor(F.col(c) / F.lit(cap))
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i in (-1, 0, 1) for k in (-1, 0, 1)]))
    a = left.select(*keys, F.col("id").alias("left_id"), F.col("x").alias("_x"), F.col("z").alias("_z"), square("x").alias("_i"), square("z").alias("_k"))
    spread = a.withColumn("_o", offsets).withColumns({"_i": F.col("_i") + F.col("_o.i"), "_k": F.col("_k") + F.col("_o.k")})
    b = right.select(*keys, F.col("id").alias("right_id"), "x", "z", square("x").alias("_i"), square("z").alias("_k"))
    met = spread.join(b, [*keys, "_i", "_k"]).withColumn("gap", F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("z") - F.col("_z")) ** 2)).where(F.col("gap") < cap)
    best = met.groupBy(*keys, "left_id").agg(F.min(F.struct("gap", "right_id")).alias("b"))
    return a.select(*keys, "left_id").join(best, [*keys, "left_id"], "left").select(*keys, "left_id", "b.right_id", "b.gap")


def error_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean, median, 90th and 95th percentile and maximum of abs_error; nulls are not counted."""
    q = F.percentile("abs_error", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    g = rows.groupBy(*keys).agg(F.count("abs_error").alias("n"), F.avg("abs_error").alias("mae"), q.alias("q"), F.max("abs_error").alias("worst"))
    return g.select(*keys, "n", "mae", *[F.col("q")[i].alias(c) for i, c in enumerate(("median", "p90", "p95"))], "worst")
