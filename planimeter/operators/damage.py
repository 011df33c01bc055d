"""Surface damage on walls: colour cells, residuals, regions, flags and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The work item of each damage class.
SCOPE = {"stain": "INTERIOR_PAINT", "discoloration": "INTERIOR_PAINT", "moisture": "MOISTURE_OPEN_AND_INSPECT"}


def colour_cells(points: DataFrame, keys: list[str], cell: float = 0.10) -> DataFrame:
    """Median colour of 10 cm cells (along, height) with two returns or more; walls need 8 cells."""
    at = [F.floor(F.col(c) / cell).alias(n) for c, n in (("along", "ia"), ("height", "ih"))]
    cells = points.groupBy(*keys, *at).agg(*[F.percentile(c, 0.5).alias(c) for c in ("l", "a", "b")], F.count(F.lit(1)).alias("n")).where("n >= 2")
    enough = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where("_c >= 8").drop("_c")
    return cells.join(enough, keys, "left_semi")


def residual_cells(cells: DataFrame, keys: list[str], norm: float = 32.0, dark: float = -12.0) -> DataFrame:
    """Cells against the median of their 5 x 5 neighbours (4 at least): dl, da, db and anomalous (far off and darker).

    Neighbours meet by an equi-join on 24 offsets, so the join grows with the cells."""
    offsets = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if i or j]
    spread = cells.select(*keys, "l", "a", "b", "ia", "ih", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])).alias("o"))
    around = spread.select(*keys, (F.col("ia") + F.col("o.i")).alias("ia"), (F.col("ih") + F.col("o.j")).alias("ih"), *[F.col(c).alias(f"n{c}") for c in "lab"])
    med = around.groupBy(*keys, "ia", "ih").agg(*[F.percentile(f"n{c}", 0.5).alias(f"n{c}") for c in "lab"], F.count(F.lit(1)).alias("near")).where("near >= 4")
    r = cells.join(med, [*keys, "ia", "ih"]).withColumns({f"d{c}": F.col(c) - F.col(f"n{c}") for c in "lab"})
    far = F.sqrt(F.col("dl") ** 2 + F.col("da") ** 2 + F.col("db") ** 2) >= norm
    return r.select(*keys, "ia", "ih", "dl", "da", "db", (far & (F.col("dl") < dark)).alias("anomalous"))


def wall_points(points: DataFrame, walls: DataFrame) -> DataFrame:
    """Coloured points (capture_id, x, y, z, r, g, b) on walls (capture_id, wall_id, x0, z0, x1, z1): capture_id, wall_id, along,
    height, l, a, b (8-bit CIE values).

    Within 0.1 m of the wall, 0.05 m from its ends, 0.15 to 1.9 m up; walls of 0.4 m or more with 30 points."""
    from pyspark.sql import Window

    from planimeter.functions.expr import rgb_to_lab, segment_coords

    c = F.col
    near = points.join(walls.select("capture_id", "wall_id", "x0", "z0", "x1", "z1"), "capture_id")
    s = segment_coords(c("x"), c("z"), *[c(n) for n in ("x0", "z0", "x1", "z1")])
    near = near.withColumns({"_s": s, "_n": F.hypot(c("x1") - c("x0"), c("z1") - c("z0"))}).where((c("_n") >= 0.4) & (F.abs("_s.across") < 0.1) & (c("_s.along") > 0.05) & (c("_s.along") < c("_n") - 0.05) & (c("y") > 0.15) & (c("y") < 1.9))
    near = near.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("capture_id", "wall_id"))).where("_k >= 30").withColumn("_lab", rgb_to_lab(c("r"), c("g"), c("b")))
    return near.select("capture_id", "wall_id", c("_s.along").alias("along"), c("y").alias("height"), *[c(f"_lab.{n}").alias(n) for n in "lab"])


def damage_regions(residuals: DataFrame, keys: list[str], cell: float = 0.10) -> DataFrame:
    """Connected anomalous cells (four neighbours) of 0.12 m2, filling 0.35 of their box, median dl -15 or darker; walls with
    under eight anomalous cells have none. class moisture if the top is at most 0.45 and db over 8, else stain.

    keys, region, class, extent_m2, sigma, n, bottom, top, along0, along1, centre (along), mean_delta_e. Walls are grouped one
    by one: a wall has some hundred cells."""
    fields = [residuals.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", region int, class string, extent_m2 double, sigma double, n long, bottom double, top double, along0 double, along1 double, centre double, mean_delta_e double"

    def parts(cells: set) -> list[list]:
        out = []
        while cells:
            todo, part = [min(cells)], []
            cells.remove(todo[0])
            while todo:
                a, h = todo.pop()
                part.append((a, h))
                beside = [n for n in ((a - 1, h), (a + 1, h), (a, h - 1), (a, h + 1)) if n in cells]
                cells.difference_update(beside)
                todo += beside
            out.append(part)
        return out

    def regions(pdf):
        import numpy as np
        import pandas as pd

        dark = pdf[pdf["anomalous"]]
        found = {(int(a), int(h)): (dl, db, float(np.sqrt(dl * dl + da * da + db * db))) for a, h, dl, da, db in zip(*[dark[n] for n in ("ia", "ih", "dl", "da", "db")], strict=True)}
        out = []
        for part in parts(set(found)) if len(found) >= 8 else []:
            along, up = [a for a, _ in part], [h for _, h in part]
            width, low, high = max(along) - min(along) + 1, min(up), max(up) + 1
            dl, db, delta = np.array([found[p] for p in part]).T
            area = len(part) * cell * cell
            if len(part) < 8 or area < 0.12 - 1e-9 or len(part) / (width * (high - low)) < 0.35 or np.median(dl) > -15:
                continue
            kind = "moisture" if high * cell <= 0.45 + 1e-9 and np.median(db) > 8 else "stain"
            place = (round(low * cell, 3), round(high * cell, 3), round(min(along) * cell, 3), round((max(along) + 1) * cell, 3), (float(np.mean(along)) + 0.5) * cell)
            out.append((kind, area, max(0.4 * area, 0.01), len(part), *place, round(float(delta.mean()), 2)))
        out.sort(key=lambda r: (r[4], r[8], r[0]))
        rows = [[pdf[k].iloc[0] for k in keys] + [i, *r] for i, r in enumerate(out)]
        return pd.DataFrame(rows, columns=[*keys, "region", "class", "extent_m2", "sigma", "n", "bottom", "top", "along0", "along1", "centre", "mean_delta_e"])

    return residuals.groupBy(*keys).applyInPandas(regions, schema)


# By tier, the least absolute and relative half-width of an extent.
EXTENT_FLOORS = {"lidar": (0.015, 0.0), "video": (0.03, 0.03), "photo": (0.03, 0.08)}


def wall_damage(points: DataFrame, walls: DataFrame, tier: str = "lidar") -> DataFrame:
    """Damage on walls (capture_id, room_id, wall_id, x0, z0, x1, z1, windows) from coloured points, end to end: capture_id,
    room_id, damage_id, wall_id, class, extent (interval), bottom, top, along0, along1, centroid (array), mean_delta_e,
    concealed_rules, concealed, confidence (null: a colour residual is no probability).

    Ids count regions of a wall from the lowest, then along the world's x."""
    from pyspark.sql import Window

    from planimeter.functions.expr import measurement

    c, keys = F.col, ["capture_id", "wall_id"]
    r = damage_regions(residual_cells(colour_cells(wall_points(points, walls), keys), keys), keys)
    j = r.join(walls, keys)
    n = F.hypot(c("x1") - c("x0"), c("z1") - c("z0"))
    centre = F.array(F.round(c("x0") + (c("x1") - c("x0")) / n * c("centre"), 3), F.round(c("z0") + (c("z1") - c("z0")) / n * c("centre"), 3))
    j = j.withColumn("centroid", centre)
    order = Window.partitionBy(*keys).orderBy("bottom", F.get("centroid", F.lit(0)), "class")
    wet = c("class").isin("stain", "moisture")
    rules = F.array_compact(F.array(F.when(wet & (c("bottom") <= 0.30) & (F.round("extent_m2", 4) >= 0.04), "base_stain_moisture_path"), F.when(wet & (F.coalesce("windows", F.lit(0)) > 0) & (c("top") >= 0.7), "sill_stain_under_window")))
    low, rel = (F.lit(x) for x in EXTENT_FLOORS[tier])
    j = j.withColumns({"damage_id": F.concat("wall_id", F.lit("_d"), (F.row_number().over(order) - 1).cast("string")), "extent": measurement(c("extent_m2"), c("sigma"), low, rel), "concealed_rules": rules})
    return j.select(
        "capture_id", "room_id", "damage_id", "wall_id", "class", "extent", "extent_m2", "bottom", "top", "along0", "along1", "centroid", "mean_delta_e", "concealed_rules", (F.size("concealed_rules") > 0).alias("concealed"),
        F.lit(None).cast("double").alias("confidence"),
    )


def picture_place(at: Column, depth_size: Column, picture_size: Column) -> Column:
    """The pixel of a larger picture over the middle of a depth pixel."""
    return F.greatest(F.lit(0.0), F.least(picture_size - 1.0, (at + 0.5) * (picture_size / depth_size) - 0.5)).cast("int")


def coloured_points(pixels: DataFrame, poses: DataFrame, pictures: DataFrame, *, most: int = 28, stride: int = 6) -> DataFrame:
    """World points with the colour of their picture: capture_id, frame, x, y, z, r, g, b.

    pixels: capture_id, frame, v, u, mm, conf, width, height. Of each capture's frames with a pose every k-th, at most 28;
    confident pixels from 0.3 to 4.5 m, frames with 20 of them, every sixth one in row order. pictures: capture_id, frame, v,
    u, r, g, b, width, height."""
    from pyspark.sql import Window

    from planimeter.functions.expr import backproject, rotate_by_quaternion

    c = F.col
    frames = pixels.select("capture_id", "frame").distinct().join(poses.select("capture_id", "frame"), ["capture_id", "frame"], "left_semi")
    w = Window.partitionBy("capture_id")
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / most))
    chosen = frames.withColumns({"_i": F.row_number().over(w.orderBy("frame")) - 1, "_s": step}).where((c("_i") % c("_s") == 0) & (c("_i") < c("_s") * most))
    frame = Window.partitionBy("capture_id", "frame")
    sure = F.when(F.max("conf").over(frame).isNull(), F.lit(True)).otherwise(F.coalesce(c("conf") >= 2, F.lit(False)))
    good = pixels.join(chosen.select("capture_id", "frame"), ["capture_id", "frame"], "left_semi").withColumn("_sure", sure).where((c("mm") > 300) & (c("mm") < 4500) & c("_sure"))
    good = good.withColumns({"_n": F.count(F.lit(1)).over(frame), "_k": F.row_number().over(frame.orderBy("v", "u")) - 1}).where((c("_n") >= 20) & (c("_k") % stride == 0))
    size = pictures.groupBy("capture_id", "frame").agg(F.first("width").alias("_w"), F.first("height").alias("_h"))
    good = good.join(size, ["capture_id", "frame"]).withColumns({"_u": picture_place(c("u"), c("width"), c("_w")), "_v": picture_place(c("v"), c("height"), c("_h"))})
    lit = good.join(pictures.select("capture_id", "frame", c("v").alias("_v"), c("u").alias("_u"), "r", "g", "b"), ["capture_id", "frame", "_v", "_u"])
    z = c("mm") / 1000.0
    moved = lit.join(poses, ["capture_id", "frame"]).withColumn("_p", rotate_by_quaternion(c("q"), backproject(c("u"), c("v"), z, *[c(n) for n in ("fx", "fy", "cx", "cy")])))
    return moved.select("capture_id", "frame", *[(c(f"_p.{a}") + F.get("t", F.lit(i))).alias(a) for i, a in enumerate("xyz")], "r", "g", "b")


def concealed_flags(walls: DataFrame, regions: DataFrame) -> DataFrame:
    """Two rules a wall, recorded whether they fire or not: ord, rule, fired, confidence (1 or 0).

    walls: capture_id, wall_id, windows (number of window openings). regions: capture_id, wall_id, class, bottom, top,
    extent_m2. base_stain_moisture_path: a stain or moisture from 0.30 m or lower, 0.04 m2 or larger.
    sill_stain_under_window: a stain or moisture that reaches 0.70 m on a wall with a window."""
    wet = F.col("class").isin("stain", "moisture")
    r = regions.groupBy("capture_id", "wall_id").agg(
        F.bool_or(wet & (F.col("bottom") <= 0.30) & (F.col("extent_m2") >= 0.04)).alias("_base"), F.bool_or(wet & (F.col("top") >= 0.70)).alias("_sill")
    )
    fired = {"base_stain_moisture_path": F.col("_base"), "sill_stain_under_window": F.col("_sill") & (F.coalesce("windows", F.lit(0)) > 0)}
    rules = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("fired")) for i, (n, c) in enumerate(fired.items())])).alias("r")
    out = walls.join(r, ["capture_id", "wall_id"], "left").select("capture_id", "wall_id", rules).select("capture_id", "wall_id", "r.*")
    return out.withColumn("confidence", F.col("fired").cast("double"))


def scope_items(regions: DataFrame) -> DataFrame:
    """Work item and quantity of each region: INSPECT for a class not in the catalogue."""
    code = F.lit("INSPECT")
    for k, v in SCOPE.items():
        code = F.when(F.col("class") == k, v).otherwise(code)
    return regions.withColumns({"code": code, "unit": F.lit("m2"), "quantity": F.round("extent_m2", 4)})
