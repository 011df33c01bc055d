"""CAD scenes to ground truth: polygons and rectangles of many scenes to rooms, walls, openings and links.

entities: scene, index, point, normal (arrays, z up), loop (array of structs x, z), span. Rooms are floor polygons in
their order; a door links two rooms only where a step through it lands in both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planimeter.functions.arrays import let, loop_distance, median
from planimeter.functions.expr import inside_polygon, shoelace

# Limits of what counts as level, a floor, a ceiling, a wall; how far walls, openings and steps reach.
LEVEL, UPRIGHT, FLOOR_Z, CEILING_Z, LEAST_AREA, LEAST_WALL, WALL_REACH, OPENING_REACH, STEP, LEAST_OPENING = 0.85, 0.35, 1.0, 1.5, 1.5, 0.40, 0.35, 0.40, 0.45, 0.40


def sorted_entities(entities: DataFrame) -> DataFrame:
    """entities with kind (floor, small, ceiling, wall or null), z and area."""
    nz, z = F.abs(F.get("normal", F.lit(2))), F.get("point", F.lit(2))
    area = shoelace(F.col("loop"))
    floor = (nz >= LEVEL) & (z < FLOOR_Z) & F.col("loop").isNotNull()
    kind = (
        F.when(floor & (area >= LEAST_AREA), "floor").when(floor, "small").when((nz >= LEVEL) & (z > CEILING_Z), "ceiling")
        .when((nz < UPRIGHT) & F.col("loop").isNotNull() & (F.col("span") >= LEAST_WALL), "wall")
    )
    return entities.withColumns({"z": z, "area": area, "kind": kind})


def floors(entities: DataFrame) -> DataFrame:
    """Rooms: scene, room_id, ord, loop, z, floor_area_m2, entity_index."""
    f = entities.where("kind = 'floor'").withColumn("ord", F.row_number().over(Window.partitionBy("scene").orderBy("index")) - 1)
    return f.select("scene", F.format_string("%s_floor_%02d", "scene", "ord").alias("room_id"), "ord", "loop", "z", F.round("area", 4).alias("floor_area_m2"), F.col("index").alias("entity_index"))


def _middle(loop: Column, k: str) -> Column:
    return F.aggregate(loop, F.lit(0.0), lambda s, p: s + p[k]) / F.size(loop)


def room_walls(entities: DataFrame, rooms: DataFrame) -> DataFrame:
    """Walls with the room whose floor their middle is in, or nearest to under 0.35 m (the first on ties): scene, room_id,
    wall_id, entity_index, length_m, loop."""
    w = entities.where("kind = 'wall'").select("scene", F.col("index").alias("entity_index"), F.col("loop").alias("_loop"), F.round("span", 4).alias("length_m"))
    w = w.withColumns({"_x": _middle(F.col("_loop"), "x"), "_z": _middle(F.col("_loop"), "z")})
    away = F.when(inside_polygon(F.col("_x"), F.col("_z"), F.col("loop")), 0.0).otherwise(loop_distance(F.col("_x"), F.col("_z"), F.col("loop")))
    met = w.join(rooms.select("scene", "room_id", "ord", "loop"), "scene").withColumn("_d", away).where(F.col("_d") < WALL_REACH)
    best = met.groupBy("scene", "entity_index").agg(F.min(F.struct("_d", "ord", "room_id")).alias("b"), F.first("length_m").alias("length_m"), F.first("_loop").alias("loop"))
    return best.select("scene", "b.room_id", F.concat("b.room_id", F.lit("_e"), F.col("entity_index").cast("string")).alias("wall_id"), "entity_index", "length_m", "loop")


def opening_size(openings: DataFrame) -> DataFrame:
    """Rectangles (vertices) with width (median of their level edges, under 25 cm of rise) and middle x, y."""
    def level(v: Column) -> Column:
        edges = F.transform(v, lambda p, i: F.zip_with(F.get(v, F.pmod(i + 1, F.size(v))), p, lambda a, b: a - b))
        long = F.transform(F.filter(edges, lambda e: F.abs(F.get(e, F.lit(2))) < 0.25), lambda e: F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)))
        return median(F.array_sort(long))

    mean = lambda i: F.aggregate("vertices", F.lit(0.0), lambda s, p: s + F.get(p, F.lit(i))) / F.size("vertices")
    return openings.withColumns({"width": let(F.col("vertices"), level), "_x": mean(0), "_y": mean(1)})


def room_openings(openings: DataFrame, walls: DataFrame) -> DataFrame:
    """Openings of 0.40 m or more on the nearest wall under 0.40 m (the first on ties): scene, room_id, opening_id, wall_id,
    width_m, class."""
    o = opening_size(openings).where(F.col("width") >= LEAST_OPENING).select("scene", "opening_id", "class", F.round("width", 4).alias("width_m"), "_x", "_y")
    met = o.join(walls.select("scene", "room_id", "wall_id", "entity_index", "loop"), "scene").withColumn("_d", loop_distance(F.col("_x"), F.col("_y"), F.col("loop"))).where(F.col("_d") < OPENING_REACH)
    best = met.groupBy("scene", "opening_id", "class", "width_m").agg(F.min(F.struct("_d", "entity_index", "room_id", "wall_id")).alias("b"))
    return best.select("scene", "b.room_id", "opening_id", "b.wall_id", "width_m", "class")


def not_scored(openings: DataFrame) -> DataFrame:
    """Rectangles too narrow to be an opening's width: scene, opening_id, class, horizontal_edge_m."""
    return opening_size(openings).where(F.col("width") < LEAST_OPENING).select("scene", "opening_id", "class", F.round("width", 4).alias("horizontal_edge_m"))


def door_links(openings: DataFrame, rooms: DataFrame) -> DataFrame:
    """Rooms on both sides of a door, a step of 0.45 m along its normal either way: scene, room_a, room_b, opening_id; of
    several doors between two rooms the first."""
    c = F.col
    d = opening_size(openings).where((c("class") == "door") & (c("width") >= LEAST_OPENING))
    n = F.hypot(F.get("normal", F.lit(0)), F.get("normal", F.lit(1)))
    d = d.withColumn("_n", F.coalesce(n, F.lit(0.0))).where("_n >= 0.2").withColumn("_s", F.explode(F.array(F.lit(-STEP), F.lit(STEP))))
    d = d.select("scene", "opening_id", "ord", "_s", (c("_x") + c("_s") * F.get("normal", F.lit(0)) / c("_n")).alias("_px"), (c("_y") + c("_s") * F.get("normal", F.lit(1)) / c("_n")).alias("_py"))
    met = d.join(rooms.select("scene", "room_id", c("ord").alias("_o"), "loop"), "scene").where(inside_polygon(c("_px"), c("_py"), c("loop")))
    hit = met.groupBy("scene", "opening_id", "ord", "_s").agg(F.min_by("room_id", "_o").alias("room_id"))
    both = hit.groupBy("scene", "opening_id", "ord").agg(F.min("room_id").alias("room_a"), F.max("room_id").alias("room_b"), F.count(F.lit(1)).alias("n")).where("n = 2 and room_a <> room_b")
    return both.groupBy("scene", "room_a", "room_b").agg(F.min_by("opening_id", "ord").alias("opening_id"))


def room_ceilings(entities: DataFrame, rooms: DataFrame) -> DataFrame:
    """Least height of a ceiling whose point lies over a room, 1.8 to 6 m: scene, room_id, ceiling_height_m (null without)."""
    up = entities.where("kind = 'ceiling'").select("scene", F.get("point", F.lit(0)).alias("_x"), F.get("point", F.lit(1)).alias("_y"), F.col("z").alias("_z"))
    rise = F.col("_z") - F.col("z")
    fits = (rise >= 1.8) & (rise <= 6.0) & inside_polygon(F.col("_x"), F.col("_y"), F.col("loop"))
    g = rooms.join(up, "scene", "left").groupBy("scene", "room_id").agg(F.min(F.when(fits, rise)).alias("h"))
    return g.select("scene", "room_id", F.round("h", 4).alias("ceiling_height_m"))


def scene_documents(entities: DataFrame, openings: DataFrame) -> DataFrame:
    """Ground truth of each scene with a floor: scene, document (JSON): rooms with walls and openings, links, footprint, and
    what was left out. CAD metres are no tape: the calibration is unavailable."""
    c = F.col
    e = sorted_entities(entities)
    rooms = floors(e)
    walls = room_walls(e, rooms)
    cut = room_openings(openings, walls).groupBy("scene", "room_id").agg(F.array_sort(F.collect_list(F.struct("opening_id", "wall_id", "width_m", "class"))).alias("openings"))
    listed = walls.groupBy("scene", "room_id").agg(F.array_sort(F.collect_list(F.struct("entity_index", "wall_id", "length_m"))).alias("walls"))
    r = rooms.join(room_ceilings(e, rooms), ["scene", "room_id"]).join(listed, ["scene", "room_id"], "left").join(cut, ["scene", "room_id"], "left")
    room = F.struct("ord", "room_id", "ceiling_height_m", F.coalesce("walls", F.array().cast(listed.schema["walls"].dataType)).alias("walls"), F.coalesce("openings", F.array().cast(cut.schema["openings"].dataType)).alias("openings"), "floor_area_m2", "entity_index")
    g = r.groupBy("scene").agg(F.array_sort(F.collect_list(room), lambda a, b: a["ord"] - b["ord"]).alias("rooms"), F.round(F.sum("floor_area_m2"), 4).alias("footprint_m2"))
    links = door_links(openings, rooms).groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("room_a", "room_b", "opening_id", F.lit("door").alias("relationship")))).alias("adjacencies"))
    small = e.where("kind = 'small'").groupBy("scene").agg(F.array_sort(F.collect_list(F.struct(c("index").alias("entity_index"), F.round("area", 4).alias("area_m2")))).alias("excluded_horizontal_polygons"))
    thin = not_scored(openings).groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("opening_id", "class", "horizontal_edge_m"))).alias("openings_not_scored"))
    j = g.join(links, "scene", "left").join(small, "scene", "left").join(thin, "scene", "left")
    lists = {n: F.coalesce(n, F.array().cast(t.schema[n].dataType)) for n, t in (("adjacencies", links), ("excluded_horizontal_polygons", small), ("openings_not_scored", thin))}
    body = F.struct(
        c("scene").alias("case_id"), F.lit("lidar").alias("tier"), F.lit(False).alias("evaluator_only"), F.struct(F.lit("unavailable").alias("scale")).alias("calibration"), "footprint_m2",
        F.transform("rooms", lambda x: x.dropFields("ord")).alias("rooms"), *[v.alias(n) for n, v in lists.items()],
    )
    return j.select("scene", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))
