"""From points to rooms: the layout of a capture composed of the steps in points, lines, layout, matching and openings.

A plan is a set of DataFrames keyed by capture_id, each written once to the shared folder where a later step reads it
more than once. Documents are JSON text, one a capture."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planimeter.functions.expr import TIER_FLOORS, measurement, overlap_length, shoelace, turned
from planimeter.functions.shared import stored
from planimeter.operators import assess, layout, lines, matching, openings, points, rooms

KEY = ["capture_id"]
#: By tier: least sigma of the position of a wall.
BASE_SIGMA = {"lidar": 0.01, "video": 0.03, "photo": 0.06}
# Reasons in the order they are given.
PHOTO_REASONS = ["low_texture", "weak_overlap", "insufficient_points", "missing_images", "scale_unavailable", "no_room_closure", "adjacency_unresolved", "overlap_rejected"]


@dataclass
class Plan:
    theta: DataFrame  # capture_id, theta
    lines: DataFrame  # capture_id, axis, pos, face_lo, face_hi, score, sigma, n, runs, support_len
    rooms: DataFrame  # capture_id, room, x0, x1, z0, z1, polygon, theta, ceiling, ceiling_sigma
    walls: DataFrame  # capture_id, room, wall, p0, p1, length, sigma, support
    openings: DataFrame  # capture_id, room, wall, opening, kind, width, ...
    notes: DataFrame  # capture_id, notes


def _axes(flat: DataFrame) -> DataFrame:
    """Both readings of each point: its distance along the axis of a wall's position, and along the wall."""
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("coord"), F.col(o).alias("along")) for a, c, o in (("x", "u", "v"), ("z", "v", "u"))])).alias("s")
    return flat.select("capture_id", "height", sides).select("capture_id", "height", "s.*")


def wall_lines(both: DataFrame, sigma: float, mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Wall lines with their faces and runs, the points near each peak, and those on steps off it.

    both: capture_id, axis, coord, along, height. A line needs 40 points within 0.11 m of its peak; with intersecting
    ends it needs 0.7 m of support; weak partitions fall out."""
    by = ["capture_id", "axis"]
    peaks = lines.merge_peaks(lines.wall_peaks(both.select(*by, F.col("coord").alias("value")), by), by)
    faces = assess.face_positions(both.select(*by, "coord"), peaks, by, sigma)
    at = peaks.select(*by, "pos", "score").join(faces, [*by, "pos"])
    near = at.select(*by, "pos").join(both, by)
    off = F.col("coord") - F.col("pos")
    band = near.where(F.abs(off) <= 0.11).select(*by, "pos", "along", "height")
    runs = lines.support_runs(openings.walking_band(band, [*by, "pos"], 10), [*by, "pos"])
    listed = runs.groupBy(*by, "pos").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))
    found = at.join(listed, [*by, "pos"], "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<a:double,b:double>>")))
    found = found.withColumn("support_len", F.aggregate("runs", F.lit(0.0), lambda s, r: s + r["b"] - r["a"]))
    if mode == "intersections":
        found = found.where("support_len >= 0.7")
    kept = layout.drop_weak_partitions(found, by).select(*by, "pos")
    found = found.join(kept, [*by, "pos"])
    steps = near.where((F.abs(off) >= 0.07) & (F.abs(off) <= 0.40) & (F.col("height") > 0.35) & (F.col("height") < 1.65)).select(*by, "pos", "along", off.alias("depth"))
    return found, band, steps


def four_walls(cells: DataFrame, found: DataFrame, mode: str) -> DataFrame:
    """The walls of each cell (capture_id, room, x0, x1, z0, z1, theta, px0, px1, pz0, pz1): wall, axis, pos, a0, a1, p0,
    p1 (world), length, sigma, support.

    With intersecting ends a wall reaches from one cross wall to the other. With observed ends it is as long as its
    line's longest run, in the middle of its side; sides without a run are left out, and so are cells of under three
    walls."""
    c = F.col
    corner = lambda x, z: F.struct(c(x).alias("x"), c(z).alias("z"))
    sides = (
        (0, "z", "pz0", "x0", "x1", corner("x0", "z0"), corner("x1", "z0")), (1, "x", "px1", "z0", "z1", corner("x1", "z0"), corner("x1", "z1")),
        (2, "z", "pz1", "x0", "x1", corner("x1", "z1"), corner("x0", "z1")), (3, "x", "px0", "z0", "z1", corner("x0", "z1"), corner("x0", "z0")),
    )
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("wall"), F.lit(axis).alias("axis"), c(pos).alias("pos"), c(a0).alias("a0"), c(a1).alias("a1"), p.alias("p"), q.alias("q")) for i, axis, pos, a0, a1, p, q in sides])).alias("w")
    walls = cells.select("capture_id", "room", "theta", each).select("capture_id", "room", "theta", "w.*")
    walls = walls.join(found.select("capture_id", "axis", "pos", "sigma", c("n").alias("support"), "runs"), ["capture_id", "axis", "pos"])
    full = c("a1") - c("a0")
    if mode == "observed":
        longest = F.array_max(F.transform("runs", lambda r: r["b"] - r["a"]))
        walls = walls.withColumn("length", longest).where("length is not null")
        walls = walls.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("capture_id", "room"))).where("_n >= 3").drop("_n")
    else:
        walls = walls.withColumn("length", full)
    share = 0.5 * (1 - c("length") / full)
    between = lambda p, q, t: F.struct(*[(c(f"{p}.{k}") + t * (c(f"{q}.{k}") - c(f"{p}.{k}"))).alias(k) for k in ("x", "z")])
    world = lambda s: turned(s["x"], s["z"], -c("theta"))
    walls = walls.withColumns({"_p": between("p", "q", share), "_q": between("q", "p", share)})
    return walls.select("capture_id", "room", "wall", "axis", "pos", "a0", "a1", world(c("_p")).alias("p0"), world(c("_q")).alias("p1"), "length", "sigma", "support")


def build_layout(cloud: DataFrame, tier: str = "lidar", mode: str = "intersections", shortest: float = 1.15, write=stored) -> Plan:
    """Rooms, walls and openings of captures from their points (capture_id, ord, x, y, z; floor at y 0, y up).

    write(df) stores a frame that several steps read and returns it. mode: intersections or observed (see four_walls). Captures without a closed room have none, and a
    note that says why."""
    c = F.col
    whole = write(layout.subsample(cloud, KEY))
    flagged = points.upright(whole)
    band = write(layout.wall_band(flagged.select("capture_id", "ord", "x", "y", "z", "vertical"), KEY))
    theta = write(layout.manhattan_angle(band, KEY))
    flat = band.join(theta, "capture_id").withColumn("_t", turned(c("x"), c("z"), c("theta"))).select("capture_id", c("_t.x").alias("u"), c("_t.z").alias("v"), c("y").alias("height"))
    both = write(_axes(flat))
    found, near, steps = wall_lines(both, BASE_SIGMA[tier], mode)
    found = write(found)
    by = ["capture_id", "axis"]
    lined = found.select(*by, "pos", "face_lo", "face_hi", "runs")
    spots = both.where("axis = 'x'").select("capture_id", c("coord").alias("x"), c("along").alias("z"))
    cells = matching.candidate_cells(lined, spots, KEY, shortest).join(theta, "capture_id")
    number = F.row_number().over(Window.partitionBy("capture_id").orderBy("px0", "pz0")) - 1
    cells = write(cells.withColumn("room", number))
    walls = write(four_walls(cells, found, mode))
    line = [*by, "pos"]
    spans = walls.select(*line, "room", "wall", "a0", "a1").withColumn("abs_floor", F.lit(TIER_FLOORS[tier][0]))
    held = spans.select(*line).distinct()
    near, steps = write(near), write(steps)
    cut = openings.openings(near.join(held, line, "left_semi"), spans, line, steps.join(held, line, "left_semi"), found.select(*line, F.explode("runs").alias("r")).select(*line, "r.*"))
    ceilings = room_ceilings(cloud, cells)
    corner = lambda x, z: turned(c(x), c(z), -c("theta"))
    polygon = F.array(corner("x0", "z0"), corner("x1", "z0"), corner("x1", "z1"), corner("x0", "z1"))
    shaped = cells.join(walls.select("capture_id", "room").distinct(), ["capture_id", "room"], "left_semi").withColumn("polygon", polygon).join(ceilings, ["capture_id", "room"], "left")
    shaped = shaped.select("capture_id", "room", "x0", "x1", "z0", "z1", "polygon", "theta", "ceiling", "ceiling_sigma")
    cut = cut.select("capture_id", "room", "wall", "opening", "kind", "width", "sigma", "along0", "along1", "sill", "head", "method", "confidence")
    return Plan(theta, found, write(shaped), walls.drop("axis", "pos", "a0", "a1"), write(cut), layout_notes(whole, band, theta, found, shaped))


def room_ceilings(cloud: DataFrame, cells: DataFrame) -> DataFrame:
    """Ceiling of each cell from the points over it; cells without a sharp one have no row."""
    c = F.col
    high = cloud.where("y > 1.85").join(cells.select("capture_id", "room", "x0", "x1", "z0", "z1", "theta"), "capture_id").withColumn("_t", turned(c("x"), c("z"), c("theta")))
    inside = (c("_t.x") > c("x0")) & (c("_t.x") < c("x1")) & (c("_t.z") > c("z0")) & (c("_t.z") < c("z1"))
    heights = high.where(inside).select("capture_id", "room", c("y").alias("height"))
    return assess.ceiling_heights(heights, ["capture_id", "room"]).select("capture_id", "room", "ceiling", c("sigma").alias("ceiling_sigma"))


def layout_notes(whole: DataFrame, band: DataFrame, theta: DataFrame, found: DataFrame, made: DataFrame) -> DataFrame:
    """What happened to each capture: too few points, no walls, the angle and lines found, no room."""
    c = F.col
    n = whole.groupBy("capture_id").agg(F.count(F.lit(1)).alias("_n"))
    per = found.groupBy("capture_id").agg(F.count_if(c("axis") == "x").alias("_v"), F.count_if(c("axis") == "z").alias("_h"))
    j = n.join(band.select("capture_id").distinct().withColumn("_band", F.lit(True)), "capture_id", "left").join(theta, "capture_id", "left").join(per, "capture_id", "left")
    j = j.join(made.groupBy("capture_id").agg(F.count(F.lit(1)).alias("_rooms")), "capture_id", "left").na.fill(0, ["_v", "_h", "_rooms"])
    said = F.concat(F.lit("manhattan theta "), F.format_number(F.degrees("theta"), 1), F.lit(" deg, vertical lines "), c("_v").cast("string"), F.lit(", horizontal lines "), c("_h").cast("string"))
    notes = (
        F.when(c("_n") < 200, F.array(F.lit("too few points to build a plan"))).when(c("_band").isNull(), F.array(F.lit("not enough wall points")))
        .when((c("_v") < 2) | (c("_h") < 2), F.array(said, F.lit("fewer than two walls in one direction; no closed room")))
        .when(c("_rooms") == 0, F.array(said, F.lit("grid produced no room cell above the minimum size"))).otherwise(F.array(said))
    )
    return j.select("capture_id", notes.alias("notes"))


def shifted(p: Column, dx: Column, dz: Column) -> Column:
    """A point (struct x, z) moved by a capture's corner, to a tenth of a millimetre."""
    return F.struct(F.round(p["x"] + dx, 4).alias("x"), F.round(p["z"] + dz, 4).alias("z"))


def aligned_to_axes(plan: Plan, degrees: float = 1.0) -> Plan:
    """Rooms of captures turned by at most `degrees` put back on the axes: half a degree is the middle of a histogram bin, no
    measured twist. Other captures stay as they are."""
    small = F.abs(F.col("theta")) <= F.radians(F.lit(degrees))
    back = lambda p, t: F.when(F.abs(t) <= F.radians(F.lit(degrees)), turned(p["x"], p["z"], t)).otherwise(p)
    rooms_ = plan.rooms.withColumn("polygon", F.transform("polygon", lambda p: back(p, F.col("theta")))).withColumn("theta", F.when(small, 0.0).otherwise(F.col("theta")))
    walls = plan.walls.join(plan.theta, "capture_id").withColumns({n: back(F.col(n), F.col("theta")) for n in ("p0", "p1")}).drop("theta")
    theta = plan.theta.withColumn("theta", F.when(small, 0.0).otherwise(F.col("theta")))
    return Plan(theta, plan.lines, rooms_, walls, plan.openings, plan.notes)


def room_documents(plan: Plan, tier: str = "lidar") -> DataFrame:
    """Rooms as nested structs with measured intervals, sorted by name within: capture_id, room (struct).

    Sigma of an area is half its perimeter times the median sigma of its walls; of a length the root of two times its
    wall's; floors are the tier's, an area's at least 0.05 m2 or the perimeter times the tier's."""
    c = F.col
    low, rel = (F.lit(float(x)) for x in TIER_FLOORS[tier])
    name = F.concat(F.lit("room_"), c("room").cast("string"))
    wall_name = F.concat(F.lit("room"), c("room").cast("string"), F.lit("_w"), c("wall").cast("string"))
    cut = plan.openings.select(
        "capture_id", "room", "wall",
        F.struct(
            F.concat(wall_name, F.lit("_o"), c("opening").cast("string")).alias("id"), c("kind").alias("class"), measurement(c("width"), c("sigma"), F.greatest(low, F.lit(0.02)), rel).alias("width_m"),
            measurement(c("sill"), F.greatest(c("sigma"), F.lit(0.03)), F.greatest(low, F.lit(0.03)), rel).alias("sill_height_m"),
            measurement(c("head"), F.greatest(c("sigma"), F.lit(0.04)), F.greatest(low, F.lit(0.04)), rel).alias("head_height_m"), c("head").isNotNull().alias("observed_head"), "method", "confidence",
        ).alias("o"),
    )
    cut = cut.groupBy("capture_id", "room", "wall").agg(F.array_sort(F.collect_list("o"), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("openings"))
    high = measurement(c("ceiling"), F.coalesce("ceiling_sigma", F.lit(0.02)), F.greatest(low, F.lit(0.015)), rel)
    shape = plan.rooms.select("capture_id", "room", "polygon", high.alias("height"))
    ends = lambda n: F.array(F.round(f"{n}.x", 4), F.round(f"{n}.z", 4))
    wall = plan.walls.join(cut, ["capture_id", "room", "wall"], "left").join(shape.select("capture_id", "room", "height"), ["capture_id", "room"]).select(
        "capture_id", "room", "sigma",
        F.struct(
            c("wall"), wall_name.alias("id"), measurement(c("length"), F.sqrt(F.lit(2.0)) * c("sigma"), low, rel).alias("length_m"), c("height").alias("height_m"), ends("p0").alias("p0_m"), ends("p1").alias("p1_m"),
            c("support").alias("support_points"), F.coalesce("openings", F.array().cast(cut.schema["openings"].dataType)).alias("openings"),
        ).alias("w"),
    )
    wall = wall.groupBy("capture_id", "room").agg(F.array_sort(F.collect_list("w"), lambda a, b: a["wall"] - b["wall"]).alias("walls"), F.percentile("sigma", 0.5).alias("_s"))
    polygon = c("polygon")
    perimeter = F.aggregate(F.transform(polygon, lambda p, i: _apart(p, F.get(polygon, F.pmod(i + 1, F.size(polygon))))), F.lit(0.0), lambda s, x: s + x)
    r = shape.join(wall, ["capture_id", "room"]).withColumn("_p", perimeter)
    area = measurement(shoelace(polygon), 0.5 * c("_p") * c("_s"), F.greatest(F.lit(0.05), low * c("_p")), rel)
    return r.select(
        "capture_id",
        F.struct(
            name.alias("id"), F.transform(polygon, lambda p: F.array(F.round(p["x"], 4), F.round(p["z"], 4))).alias("polygon_m"), area.alias("floor_area_m2"), c("height").alias("ceiling_height_m"),
            c("height").isNotNull().alias("ceiling_observed"), F.transform("walls", lambda w: w.dropFields("wall")).alias("walls"), F.array().cast("array<string>").alias("damage"),
        ).alias("room"),
    )


def _apart(p: Column, q: Column) -> Column:
    return F.hypot(q["x"] - p["x"], q["z"] - p["z"])


def footprint(plan: Plan) -> DataFrame:
    """capture_id, footprint_m2: the sum of its rooms' areas."""
    return layout.footprints(plan.rooms, KEY)


def stitched(placed: DataFrame, most: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between rooms (capture_id, room_id, polygon) that share an edge, their overlaps, and per capture overlap_m2 and
    connected.

    Any overlap over 0.05 m2 rejects all links of its capture. A capture is connected if no room overlaps and links join
    all; one without rooms has no row. Rooms of a capture are some tens."""
    c = F.col
    over = rooms.convex_overlaps(placed, most)
    clear = rooms.shared_edges(placed).join(over.select("capture_id").distinct(), "capture_id", "left_anti")
    parts = rooms.reachable(clear, placed).groupBy("capture_id").agg(F.count_distinct("component").alias("_parts"))
    total = over.groupBy("capture_id").agg(F.sum("area_m2").alias("_sum"))
    state = parts.join(total, "capture_id", "left").select("capture_id", F.round(F.coalesce("_sum", F.lit(0.0)), 4).alias("overlap_m2"), ((c("_parts") == 1) & c("_sum").isNull()).alias("connected"))
    return clear, over.withColumn("area_m2", F.round("area_m2", 4)), state


def photo_reasons(state: DataFrame) -> DataFrame:
    """status and ordered degraded_reasons of property plans: capture_id, found (array), n_rooms, overlapping, connected."""
    extra = F.array_compact(F.array(
        F.when(F.col("overlapping"), "overlap_rejected"), F.when(~F.col("overlapping") & (F.col("n_rooms") > 0) & ~F.col("connected"), "adjacency_unresolved"), F.when(F.col("n_rooms") == 0, "no_room_closure"),
    ))
    every = layout.ordered_reasons(F.concat(F.coalesce("found", F.array().cast("array<string>")), extra), PHOTO_REASONS)
    s = state.withColumn("degraded_reasons", every)
    fine = (F.size("degraded_reasons") == 0) & (F.col("n_rooms") > 0) & F.col("connected")
    return s.withColumn("status", F.when(fine, "ok").otherwise("degraded")).drop("found")


def compared(first: Plan, second: Plan, reach: float = 3.0) -> DataFrame:
    """Walls of two plans of the same captures: capture_id, room_a, room_b, wall, length_a_m, length_b_m, abs_delta_m,
    midpoint_distance_m, tolerance_m, passed (within 1 cm or 0.5 %).

    Rooms of the first take, in their order, the nearest room of the second left within 3 m; their walls the closest in
    length within 20 degrees and 1.2 m."""
    pairs = nearest_rooms(first.rooms, second.rooms, reach)

    def ends(p: Plan, side: str, other: str) -> DataFrame:
        w = p.walls.select("capture_id", F.col("room").alias(f"room_{side}"), F.col("wall").alias("id"), *[F.col(f"{e}.{k}").alias(f"{k}{i}") for i, e in enumerate(("p0", "p1")) for k in "xz"])
        return w.join(pairs, ["capture_id", f"room_{side}"])

    m = layout.match_walls(ends(first, "a", "b"), ends(second, "b", "a"), ["capture_id", "room_a", "room_b"])
    tolerance = F.greatest(F.lit(0.01), 0.005 * F.round("left_length", 4))
    return m.select(
        "capture_id", "room_a", "room_b", F.col("left_id").alias("wall"), F.round("left_length", 4).alias("length_a_m"), F.round("right_length", 4).alias("length_b_m"), F.round("delta", 4).alias("abs_delta_m"),
        F.round("apart", 4).alias("midpoint_distance_m"), F.round(tolerance, 4).alias("tolerance_m"), (F.round("delta", 4) <= tolerance).alias("passed"),
    )


def nearest_rooms(first: DataFrame, second: DataFrame, reach: float = 3.0) -> DataFrame:
    """Rooms of the first, in their order, each with the nearest room of the second that is left within reach; a fold over
    a capture's rooms."""
    centre = lambda k: F.aggregate("polygon", F.lit(0.0), lambda s, p: s + p[k]) / F.size("polygon")
    listed = lambda t, n: t.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("room", centre("x").alias("x"), centre("z").alias("z")))).alias(n))
    j = listed(first, "a").join(listed(second, "b"), "capture_id")

    def step(acc: Column, p: Column) -> Column:
        gaps = F.transform(acc["left"], lambda q: F.struct(F.hypot(q["x"] - p["x"], q["z"] - p["z"]).alias("d"), q["room"].alias("room")))
        best = F.array_min(F.filter(gaps, lambda g: g["d"] < reach))
        left = F.filter(acc["left"], lambda q: best.isNull() | (q["room"] != best["room"]))
        return F.struct(left.alias("left"), F.concat(acc["rows"], F.array(F.struct(p["room"].alias("a"), best["room"].alias("b")))).alias("rows"))

    start = F.struct(F.col("b").alias("left"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("rows"))
    pairs = j.select("capture_id", F.explode(F.aggregate("a", start, step)["rows"]).alias("r"))
    return pairs.select("capture_id", F.col("r.a").alias("room_a"), F.col("r.b").alias("room_b")).where("room_b is not null")


def halves(cloud: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of even and of odd frames: one walk seen twice, a stand-in for two captures."""
    return cloud.where("frame_index % 2 = 0"), cloud.where("frame_index % 2 = 1")


def supported_share(found: DataFrame, low: Column, high: Column) -> Column:
    """Share of a span that a line's runs cover."""
    return overlap_length(F.col("runs"), low, high) / (high - low)
