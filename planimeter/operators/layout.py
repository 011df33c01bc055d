"""Layout before rooms, and the checks and states around a plan. A missing side is a state, never a number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planimeter.functions.expr import eligible_source, gate_status, shoelace
from planimeter.functions.shared import stored

# Suffixes of stills, and files of a room folder that are not stills but belong there.
STILLS = (".jpg", ".jpeg", ".png")
BESIDE = ("synthetic_walls.json", "adjacency.json")
# By tier, the largest relative error of a wall.
WALL_REL = {"photo": 0.08, "video": 0.03}
# Of nine bits in a row (0 to 511): how many, the sum of their squared steps from the middle and of their places, in 16 bits each.
NINE_BITS = [sum(1 + ((i - 4) ** 2 << 16) + (i << 32) for i in range(9) if m >> i & 1) for m in range(512)]


def subsample(points: DataFrame, keys: list[str], most: int = 700_000) -> DataFrame:
    """Every k-th row of a capture (by ord) that has over `most` rows, k = rows // most; smaller ones whole."""
    w = Window.partitionBy(*keys)
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / most))
    numbered = points.withColumns({"_k": step, "_i": F.row_number().over(w.orderBy("ord")) - 1})
    return numbered.where("_i % _k = 0").drop("_k", "_i")


def first_in_cells(points: DataFrame, keys: list[str], size: float) -> DataFrame:
    """The first point (by ord) of each square of the floor plan, whatever its height."""
    cell = lambda c: F.floor(F.col(c) / size)
    g = points.groupBy(*keys, cell("x").alias("kx"), cell("z").alias("kz")).agg(F.min(F.struct("ord", "x", "z")).alias("p"))
    return g.select(*keys, "kx", "kz", "p.*")


def wall_band(points: DataFrame, keys: list[str]) -> DataFrame:
    """The points (y, vertical) that walls are read from.

    Those of vertical columns between 0.8 and 1.9 m if over 400, else all of vertical columns; where that leaves under
    150, all points between 0.8 and 1.8 m. Captures with under 200 points, or under 80 left, give none."""
    w, y = Window.partitionBy(*keys), F.col("y")
    upright = F.coalesce("vertical", F.lit(False))
    kinds = {"_band": upright & (y > 0.8) & (y < 1.9), "_mask": upright, "_mid": (y > 0.8) & (y < 1.8)}
    p = points.withColumns(kinds | {"_n": F.count(F.lit(1)).over(w)})
    p = p.withColumns({f"{k}_n": F.count_if(k).over(w) for k in kinds})
    dense = F.col("_band_n") > 400
    p = p.withColumns({"_keep": F.when(dense, F.col("_band")).otherwise(F.col("_mask")), "_left": F.when(dense, F.col("_band_n")).otherwise(F.col("_mask_n"))})
    fall = F.col("_left") < 150
    p = p.withColumns({"_keep": F.when(fall, F.col("_mid")).otherwise(F.col("_keep")), "_left": F.when(fall, F.col("_mid_n")).otherwise(F.col("_left"))})
    return p.where("_keep and _left >= 80 and _n >= 200").select(*points.columns)


def _spreads(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Of each square (keys, cx, cz; rows may repeat) the occupied ones of the 9 x 9 about it: keys, n, and sums of their steps
    sx, sz, sxx, szz, sxz.

    A column's squares are bits of blocks of 56 with four more on either side, and the blocks of a strip are read in order of
    columns with four before and four after, so nothing is joined and no square is held against 81 others."""
    c = F.col
    each = lambda low, high, step=1: F.explode(F.array(*[F.lit(i) for i in range(low, high + 1, step)]))
    at = F.pmod("cz", F.lit(56))
    touched = F.when(at < 4, F.array(F.lit(0), F.lit(-1))).when(at > 51, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    placed = cells.where("cx is not null and cz is not null").withColumn("_s", F.explode(touched))
    bit = F.expr("shiftleft(1L, cast(pmod(cz, 56) - 56 * _s + 4 as int))")
    blocks = placed.groupBy(*keys, "cx", (F.floor(c("cz") / 56) + c("_s")).alias("_b")).agg(F.bit_or(bit).alias("_m"))
    w = Window.partitionBy(*keys, "_b").orderBy("cx")
    others = [(f, i) for f in (F.lag, F.lead) for i in range(1, 5)]
    strips = blocks.withColumns({f"{n}{j}": f(c(of), i).over(w) for j, (f, i) in enumerate(others) for n, of in (("_x", "cx"), ("_m", "_m"))})
    step = lambda j: c(f"_x{j}") - c("cx")
    near = lambda j, v: F.coalesce(F.when(F.abs(step(j)) <= 4, v), F.lit(0).cast("long"))
    nine = [(F.lit(4).cast("long"), c("_m")), *[(near(j, step(j) + 4), near(j, c(f"_m{j}"))) for j in range(8)]]
    beside = strips.select(*keys, *[v.alias(f"{n}{j}") for j, pair in enumerate(nine) for n, v in zip(("k", "m"), pair)])
    some = beside.withColumn("_y", each(0, 48, 8)).where("(shiftrightunsigned(m0, _y + 4) & 255) <> 0")
    voters = some.withColumn("_t", each(0, 7)).withColumn("_o", c("_y") + c("_t")).where("(shiftrightunsigned(m0, _o + 4) & 1) = 1")
    sums = F.expr(f"array({', '.join(f'{n}L' for n in NINE_BITS)})")
    of = lambda j: F.coalesce(F.get(sums, F.expr(f"cast(shiftrightunsigned(m{j}, _o) & 511L as int)")), F.lit(0).cast("long"))
    v = voters.select(*keys, *[f"k{j}" for j in range(9)], *[of(j).alias(f"p{j}") for j in range(9)])
    total = lambda weigh: sum((weigh(c(f"p{j}"), c(f"k{j}")) for j in range(1, 9)), weigh(c("p0"), c("k0")))
    v = v.select(*keys, total(lambda p, k: p).alias("a0"), total(lambda p, k: p * k).alias("a1"), total(lambda p, k: p * k * k).alias("a2"))
    low, high = (lambda a: c(a).bitwiseAND(F.lit(65535))), lambda a: F.shiftrightunsigned(a, 32)
    squared = F.shiftrightunsigned("a0", 16).bitwiseAND(F.lit(65535))
    v = v.select(*keys, low("a0").alias("n"), low("a1").alias("k1"), low("a2").alias("k2"), high("a0").alias("j1"), high("a1").alias("kj"), squared.alias("szz"))
    n, k1, k2, j1, kj = map(c, ("n", "k1", "k2", "j1", "kj"))
    return v.select(*keys, "n", (k1 - 4 * n).alias("sx"), (j1 - 4 * n).alias("sz"), (k2 - 8 * k1 + 16 * n).alias("sxx"), "szz", (kj - 4 * j1 - 4 * k1 + 16 * n).alias("sxz"))


def manhattan_angle(points: DataFrame, keys: list[str], size: float = 0.05) -> DataFrame:
    """theta: the direction of walls within a right angle, from the spread of occupied squares about each square.

    A square counts if eight or more of the 9 x 9 about it are occupied and their spread is four times longer than
    wide; it votes with that ratio in one of 90 bins. Every square of a capture may vote. Sums are of whole numbers, so ties
    are exact. Captures of under 50 points, 30 squares or 25 votes have theta 0."""
    c = F.col
    cell = lambda a: F.floor(F.col(a) / size)
    g = _spreads(points.select(*keys, cell("x").alias("cx"), cell("z").alias("cz")), keys)
    over = F.when(c("n") >= 8, c("n") * (c("n") - 1.0))
    # No filters here: the planner would move them down and write each column out in every place that reads it.
    g = g.select(*keys, *[((c("n") * c(ab) - c(f"s{ab[1]}") * c(f"s{ab[2]}")) / over).alias(name) for name, ab in (("a", "sxx"), ("d", "szz"), ("b", "sxz"))])
    half, root = (c("a") + c("d")) / 2, F.sqrt(((c("a") - c("d")) / 2) * ((c("a") - c("d")) / 2) + c("b") * c("b"))
    angle = F.pmod(0.5 * F.atan2(2 * c("b"), c("a") - c("d")), F.lit(math.pi / 2))
    g = g.select(*keys, (half + root).alias("hi"), (half - root).alias("lo"), F.least(F.floor(angle / (math.pi / 180)), F.lit(89)).alias("bin"))
    g = g.select(*keys, "bin", F.when(c("lo") > 1e-6, c("hi") / c("lo")).alias("w"))
    votes = g.select(*keys, *[F.when(c("w") >= 4, c(n)).alias(n) for n in ("bin", "w")])
    bins = votes.groupBy(*keys, "bin").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    voted = lambda v: F.when(c("bin").isNotNull(), v)
    best = bins.groupBy(*keys).agg(F.max(voted(F.struct("w", (-c("bin")).alias("b")))).alias("m"), F.sum(voted(c("n"))).alias("v"), F.sum("n").alias("n"))
    found = best.where("v >= 25 and n >= 30").select(*keys, ((0.5 - c("m.b")) * (math.pi / 180)).alias("theta"))
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_p"))
    return counts.join(found, keys, "left").select(*keys, F.when(c("_p") >= 50, c("theta")).alias("theta")).na.fill(0.0, ["theta"])


def drop_weak_partitions(lines: DataFrame, keys: list[str], gap: float = 0.50) -> DataFrame:
    """Of a capture's lines (pos, score, support_len) those that are walls.

    In order of position a line under `gap` from the last kept replaces it if its score is higher; of over two left,
    those with 0.38 of the best score and 1.35 m of support stay, the two best scores if that leaves under two.
    Captures of one or two lines are not touched. A capture has some dozens of lines."""
    fields = ("pos", "score", "support_len")
    none = F.expr("cast(array() as array<struct<pos:double,score:double,support_len:double>>)")

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        far = (F.size(acc) == 0) | (F.abs(p["pos"] - last["pos"]) >= gap)
        return F.when(far, F.concat(acc, F.array(p))).when(p["score"] > last["score"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(p))).otherwise(acc)

    g = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(f).cast("double").alias(f) for f in fields]))).alias("l"))
    g = g.withColumn("m", F.when(F.size("l") <= 2, F.col("l")).otherwise(F.aggregate("l", none, step)))
    g = g.withColumn("top", F.array_max(F.transform("m", lambda p: p["score"])))
    g = g.withColumn("k", F.filter("m", lambda p: (p["score"] >= 0.38 * F.col("top")) & (p["support_len"] >= 1.35)))
    ranked = F.slice(F.array_sort(F.transform("m", lambda p: F.struct((-p["score"]).alias("s"), p.alias("p")))), 1, 2)
    two = F.array_sort(F.transform(ranked, lambda r: r["p"]))
    kept = F.when(F.size("m") <= 2, F.col("m")).when(F.size("k") < 2, two).otherwise(F.col("k"))
    return g.select(*keys, F.explode(kept).alias("p")).select(*keys, "p.*")


def nearest_point(left: DataFrame, right: DataFrame, keys: list[str], strips: int = 32) -> DataFrame:
    """For each left point (id, x, z) the nearest right one of the same capture, the smaller id on ties.

    Points of one place are searched once. A capture is cut at quantiles of its right points into strips along x and each strip
    along z, 1024 cells; a left cell looks into those right cells that can be nearer than the farthest corners of its
    nearest one. Exact; work is the points times those of some cells. Points without a finite place, and captures without such
    a right point, are held against all places: a distance that is no number comes after all others, a null one last."""
    c = F.col
    inf = float("inf")

    def placed(t: DataFrame, id_: str, x: str, z: str) -> DataFrame:
        x0, z0, gone = c("x").cast("double"), c("z").cast("double"), c("x").isNull() | c("z").isNull()
        some = lambda v: F.when(gone, 0.0).otherwise(v)
        fine = ~gone & (F.abs(x0) < inf) & (F.abs(z0) < inf)
        return t.select(*keys, c("id").alias(id_), gone.alias(f"_gone{x}"), some(x0).alias(x), some(z0).alias(z), fine.alias(f"_fine{x}"))

    l, r = placed(left, "left_id", "_x", "_z"), placed(right, "right_id", "x", "z")
    here = [*keys, "_gone_x", "_x", "_z"]
    spots = l.select(*here, "_fine_x").distinct()
    targets = r.groupBy(*keys, "_gonex", "x", "z", "_finex").agg(F.min("right_id").alias("right_id"))
    dx, dz = c("x") - c("_x"), c("z") - c("_z")
    d2 = F.when(~c("_gone_x") & ~c("_gonex"), dx * dx + dz * dz)
    first = F.min(F.struct(d2.isNull().alias("none"), d2.alias("d2"), "right_id")).alias("b")

    shares = F.array(*[F.lit(k / strips) for k in range(1, strips)])
    seen = targets.where("_finex")
    cut_x = seen.groupBy(*keys).agg(F.percentile_approx("x", shares, F.lit(10_000)).alias("_cx"))
    at = lambda cuts, v: F.size(F.filter(cuts, lambda q: q < v))
    strip = seen.join(cut_x, keys).withColumn("_si", at(c("_cx"), c("x"))).drop("_cx")
    cut_z = strip.groupBy(*keys, "_si").agg(F.percentile_approx("z", shares, F.lit(10_000)).alias("_cz"))
    cell = lambda z: at(F.coalesce("_cz", F.array().cast("array<double>")), c(z))
    rc = strip.join(cut_z, [*keys, "_si"]).withColumn("_sj", cell("z")).drop("_cz")
    lc = spots.where("_fine_x").join(cut_x, keys).withColumn("_li", at(c("_cx"), c("_x"))).drop("_cx")
    lc = lc.join(cut_z.withColumnRenamed("_si", "_li"), [*keys, "_li"], "left").withColumn("_lj", cell("_z")).drop("_cz")

    box = lambda t, by, x, z, s: t.groupBy(*keys, *by).agg(*[f(v).alias(f"{s}{n}{a}") for a, v in (("x", x), ("z", z)) for n, f in (("lo", F.min), ("hi", F.max))])
    pairs = box(lc, ("_li", "_lj"), "_x", "_z", "l").join(box(rc, ("_si", "_sj"), "x", "z", "r"), keys)
    gap = lambda a: F.greatest(c(f"rlo{a}") - c(f"lhi{a}"), c(f"llo{a}") - c(f"rhi{a}"), F.lit(0.0))
    reach = lambda a: F.greatest(c(f"rhi{a}") - c(f"llo{a}"), c(f"lhi{a}") - c(f"rlo{a}"))
    pairs = pairs.withColumns({"_near": gap("x") * gap("x") + gap("z") * gap("z"), "_far": reach("x") * reach("x") + reach("z") * reach("z")})
    of = Window.partitionBy(*keys, "_li", "_lj")
    pairs = pairs.withColumn("_most", F.min("_far").over(of)).where("_near <= _most").select(*keys, "_li", "_lj", "_si", "_sj")
    met = lc.join(pairs.hint("merge"), [*keys, "_li", "_lj"]).join(rc.hint("merge"), [*keys, "_si", "_sj"])
    best = stored(met.groupBy(*here).agg(first))
    rest = spots.join(best, here, "left_anti").join(targets, keys).groupBy(*here).agg(first)
    found = l.join(best.unionByName(rest), here)
    return found.select(*keys, "left_id", "b.right_id", F.sqrt("b.d2").alias("distance"))


def match_walls(left: DataFrame, right: DataFrame, keys: list[str], degrees: float = 20.0, reach: float = 1.2) -> DataFrame:
    """For each left wall (id, x0, z0, x1, z1) of a room the right wall of the room closest in length, among those within
    20 degrees and 1.2 m between midpoints; the smaller id on ties. A right wall may serve twice; no partner, no row."""
    def shaped(t: DataFrame, s: str) -> DataFrame:
        dx, dz = F.col("x1") - F.col("x0"), F.col("z1") - F.col("z0")
        return t.select(
            *keys, F.col("id").alias(f"{s}_id"), F.atan2(dz, dx).alias(f"{s}_a"), F.sqrt(dx * dx + dz * dz).alias(f"{s}_length"),
            (0.5 * (F.col("x0") + F.col("x1"))).alias(f"{s}_x"), (0.5 * (F.col("z0") + F.col("z1"))).alias(f"{s}_z"),
        )

    c = F.col
    met = shaped(left, "left").join(shaped(right, "right"), keys)
    turn = F.abs(F.pmod(c("left_a") - c("right_a") + math.pi / 2, F.lit(math.pi)) - math.pi / 2)
    apart = F.sqrt((c("left_x") - c("right_x")) * (c("left_x") - c("right_x")) + (c("left_z") - c("right_z")) * (c("left_z") - c("right_z")))
    met = met.withColumns({"delta": F.abs(c("left_length") - c("right_length")), "apart": apart}).where((turn <= math.radians(degrees)) & (apart <= reach))
    best = met.groupBy(*keys, "left_id").agg(F.min(F.struct("delta", "right_id", "left_length", "right_length", "apart")).alias("b"))
    return best.select(*keys, "left_id", "b.*")


def footprints(rooms: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the areas of a capture's rooms (polygon)."""
    return rooms.groupBy(*keys).agg(F.sum(shoelace(F.col("polygon"))).alias("footprint_m2"))


def track_quality(frames: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """low_texture: the median of frames' keypoints is under 80, or over 45 % of frames have under 25.
    weak_overlap: no pair (used) was tried, under three were used, or under 30 % of four or more."""
    f = frames.groupBy(*keys).agg(F.percentile("keypoints", 0.5).alias("m"), F.avg((F.col("keypoints") < 25).cast("int")).alias("few"))
    p = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("tried"), F.count_if("used").alias("used"))
    j = f.join(p, keys, "full_outer").na.fill(0, ["tried", "used"])
    low = F.coalesce((F.col("m") < 80) | (F.col("few") > 0.45), F.lit(False))
    weak = (F.col("used") < 3) | ((F.col("tried") >= 4) & (F.col("used") / F.col("tried") < 0.3))
    return j.select(*keys, low.alias("low_texture"), weak.alias("weak_overlap"))


def concealed_summary(flags: DataFrame, keys: list[str]) -> DataFrame:
    """The first fired rule (by ord) of each capture with its surface; flag false where none fired."""
    g = flags.groupBy(*keys).agg(F.min(F.when(F.coalesce("fired", F.lit(False)), F.struct("ord", "rule", "surface_id"))).alias("b"))
    return g.select(*keys, F.col("b").isNotNull().alias("flag"), "b.rule", "b.surface_id")


def wall_passes(tier: Column, abs_error: Column, rel_error: Column, abs_limit: float | None = None) -> Column:
    """A wall within its tier's relative limit, or within abs_limit where one is set; null where neither limit exists."""
    rel = F.lit(None).cast("double")
    for name, limit in WALL_REL.items():
        rel = F.when(tier == name, F.lit(limit)).otherwise(rel)
    by_rel = F.when(rel.isNotNull(), F.coalesce(rel_error <= rel, F.lit(False)))
    return by_rel if abs_limit is None else F.coalesce(by_rel, F.lit(False)) | (abs_error <= abs_limit)


def calibration_status(record: Column, scale_source: Column, estimated: Column) -> Column:
    """measured, estimated or unavailable: what the truth's record says, else estimated if the plan says so."""
    claimed = F.coalesce(estimated, F.lit(False)) | F.coalesce(scale_source.contains("estimated"), F.lit(False))
    return F.when(record.isin("measured", "estimated", "unavailable"), record).when(claimed, "estimated").otherwise("unavailable")


def stitch_gate(plans: DataFrame, differences: DataFrame, keys: list[str], limit: float = 0.08) -> DataFrame:
    """status of stitched plans (n_rooms, n_rooms_truth, overlap, overlap_max, footprint, footprint_truth, source, synthetic).

    differences: keys, status (missed or phantom), as rooms.link_difference() gives. All rooms, no link too many or too
    few, no more overlap than allowed and a footprint within 8 %. A synthetic scene, a source that is not physical or a
    footprint without truth: BLOCKED."""
    d = differences.groupBy(*keys).agg(F.count_if(F.col("status") == "missed").alias("n_missing"), F.count_if(F.col("status") == "phantom").alias("n_false"))
    j = plans.join(d, keys, "left").na.fill(0, ["n_missing", "n_false"])
    off = F.try_divide(F.abs(F.col("footprint") - F.col("footprint_truth")), F.abs("footprint_truth"))
    fine = F.coalesce("overlap", F.lit(0.0)) <= F.coalesce("overlap_max", F.lit(0.0))
    passed = F.when(off.isNotNull(), (F.col("n_rooms") == F.col("n_rooms_truth")) & (F.col("n_missing") == 0) & (F.col("n_false") == 0) & fine & (off <= limit))
    eligible = eligible_source(F.col("source")) & ~F.coalesce("synthetic", F.lit(False))
    return j.select(*keys, "n_missing", "n_false", F.round(100 * off, 4).alias("footprint_error_percent"), gate_status(eligible, passed).alias("status"))


def metres(value_m: Column, value: Column, unit: Column) -> Column:
    """A length from its aliases, centimetres turned to metres."""
    v = F.coalesce(value_m, value).cast("double")
    return F.when(unit == "cm", v / 100.0).otherwise(v)


def rows_by_room(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Measurements (ord, id, room_id) listed by room; without a room: unknown. A room has some dozens."""
    g = rows.groupBy(*keys, F.coalesce("room_id", F.lit("unknown")).alias("room_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("l"))
    return g.select(*keys, "room_id", F.col("l.id").alias("ids"))


def photo_issues(roots: DataFrame, files: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Issue codes of photo folders: keys, code, room_id, name; name is null for codes of a room or of the folder.

    roots: keys, physical. files: keys, room_id, name. expected: keys, room_id. Names that start with a dot are not
    looked at. A still in three rooms is reported for each room after the first."""
    seen = files.where(~F.col("name").startswith("."))
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    still = seen.withColumn("_still", suffix.isin(*STILLS))
    none = F.lit(None).cast("string")
    row = lambda t, code, name=none: t.select(*keys, F.lit(code).alias("code"), "room_id", name.alias("name"))
    counts = still.groupBy(*keys, "room_id").agg(F.count_if("_still").alias("n"))
    named = still.groupBy(*keys, "room_id", "name").agg(F.count(F.lit(1)).alias("n"), F.bool_or("_still").alias("_still"))
    w = Window.partitionBy(*keys, "name").orderBy("room_id")
    again = named.where("_still").withColumn("_b", F.lag("room_id").over(w)).where("_b is not null")
    empty = roots.join(files, keys, "left_anti").withColumn("room_id", none)
    parts = [
        row(expected.join(files.select(*keys, "room_id").distinct(), [*keys, "room_id"], "left_anti"), "missing_room"),
        row(empty, "missing_room"),
        row(still.where(~F.col("_still") & ~F.col("name").isin(*BESIDE)), "unsupported_format", F.col("name")),
        row(again, "image_in_two_rooms", F.col("name")),
        row(named.where("n > 1"), "duplicate_filename", F.col("name")),
        row(counts.where("n < 2"), "fewer_than_2"),
        row(counts.where("n > 8"), "more_than_8"),
        row(roots.where(~F.coalesce("physical", F.lit(False))).withColumn("room_id", none), "missing_calibration"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tier_status(has_plan: Column, state: Column, n_rooms: Column) -> Column:
    """BLOCKED without a plan, DEGRADED if it says so or has no rooms, else RAN."""
    weak = F.coalesce(state == "degraded", F.lit(False)) | (F.coalesce(n_rooms, F.lit(0)) == 0)
    return F.when(~F.coalesce(has_plan, F.lit(False)), "BLOCKED").when(weak, "DEGRADED").otherwise("RAN")


def ordered_reasons(found: Column, allowed: list[str]) -> Column:
    """The found reasons that are allowed, once each and in the allowed order."""
    known = F.coalesce(found, F.array().cast("array<string>"))
    return F.filter(F.array(*map(F.lit, allowed)), lambda r: F.array_contains(known, r))


def video_reason(reasons: Column, notes: Column) -> Column:
    """The one reason given for a degraded video plan."""
    known = F.coalesce(reasons, F.array().cast("array<string>"))
    out = F.when(F.array_contains(known, "missing_pose"), "missing_pose")
    for r in ("low_texture", "weak_overlap"):
        out = out.when(F.array_contains(known, r), r)
    thin = F.array_contains(known, "insufficient_points") | F.coalesce(notes.contains("not enough wall points"), F.lit(False))
    return out.when(thin, "insufficient_wall_support").otherwise("no_room_closure")


def incumbent_length(length_m: Column, in_metres: Column, length: Column, unit: Column) -> Column:
    """A vendor's wall length in metres from its three spellings; null where no spelling is in metres."""
    return F.coalesce(length_m, in_metres, F.when(unit.isNull() | (unit == "m"), length)).cast("double")


def folder_fingerprints(files: DataFrame, keys: list[str]) -> DataFrame:
    """sha256 of each folder's relative paths and sizes, in order of path parts; files: keys, path, size."""
    part = F.struct(F.split("path", "/").alias("o"), F.concat("path", F.col("size").cast("string")).alias("s"))
    g = files.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("l"))
    return g.select(*keys, F.sha2(F.concat_ws("", F.col("l.s")), 256).alias("fingerprint"))
