"""Made-up inputs by rule: rooms and painted walls on a lattice, free of noise, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pitch of the lattice, lowest point of a wall, distance of its second sheet.
PITCH, BASE, THICK = 0.05, 0.35, 0.02


def ticks(low: Column, high: Column, pitch: float = PITCH) -> Column:
    """Multiples of the pitch from low to high, both rounded to one; counted, so that steps do not drift."""
    whole = lambda v: F.rint(v / pitch).cast("long")
    return F.transform(F.sequence(whole(low), whole(high)), lambda i: i * F.lit(pitch))


def room_cloud(specs: DataFrame) -> DataFrame:
    """Points of rectangular rooms (capture_id, x0, z0, x1, z1, height_m) in a frame whose origin is their corner: capture_id, ord,
    x, y, z, frame_index 0. A floor, and on each side two sheets of returns 2 cm apart from 0.35 m up."""
    c = F.col
    s = specs.select("capture_id", (c("x1") - c("x0")).alias("w"), (c("z1") - c("z0")).alias("d"), "height_m")
    zero = F.lit(0.0)
    xs, zs, ys = ticks(zero, c("w")), ticks(zero, c("d")), ticks(F.lit(BASE), c("height_m"))
    floor = s.select("capture_id", F.explode(xs).alias("x"), "d").select("capture_id", "x", zero.alias("y"), F.explode(zs).alias("z"))
    up = s.withColumns({"xs": xs, "zs": zs}).select("capture_id", "xs", "zs", F.explode(ys).alias("y"))
    sheet = lambda at, far: F.explode(F.array(at, at + THICK, far - THICK, far))
    ends = lambda a: (F.get(a, F.lit(0)), F.element_at(a, -1))
    along_x = up.withColumn("x", F.explode("xs")).select("capture_id", "x", "y", sheet(*ends(c("zs"))).alias("z"))
    along_z = up.withColumn("z", F.explode("zs")).select("capture_id", sheet(*ends(c("xs"))).alias("x"), "y", "z")
    points = floor.unionByName(along_x).unionByName(along_z)
    return points.select("capture_id", F.xxhash64("x", "y", "z").alias("ord"), "x", "y", "z", F.lit(0).alias("frame_index"))


def painted_walls(walls: DataFrame, patches: DataFrame, pitch: float, low: float, high: float, rgb: tuple[int, int, int]) -> DataFrame:
    """Coloured points of walls (capture_id, wall_id, x0, z0, x1, z1) with patches (capture_id, wall_id, a0, a1, h0, h1, r, g, b)
    painted on: capture_id, x, y, z, r, g, b. Of patches that overlap the one that reaches farthest along counts."""
    c = F.col
    n = F.hypot(c("x1") - c("x0"), c("z1") - c("z0"))
    along = F.transform(F.sequence(F.lit(1), F.floor((n - 2 * pitch) / pitch + 1e-6).cast("int") + 1), lambda i: i * F.lit(pitch))
    up = F.transform(F.sequence(F.lit(0), F.lit(int((high - low) / pitch + 1e-6))), lambda i: F.lit(low) + i * F.lit(pitch))
    lit = walls.withColumns({"n": n, "a": F.explode(along)}).withColumn("h", F.explode(up))
    p = patches.select("capture_id", "wall_id", "a0", "a1", "h0", "h1", *[c(k).alias(f"_{k}") for k in "rgb"])
    on = ["capture_id", "wall_id"]
    inside = (c("a") >= c("a0")) & (c("a") < c("a1")) & (c("h") >= c("h0")) & (c("h") < c("h1"))
    j = lit.join(p, on, "left").withColumn("_in", F.when(inside, F.struct("a1", "_r", "_g", "_b")))
    g = j.groupBy(*on, "x0", "z0", "x1", "z1", "n", "a", "h").agg(F.max("_in").alias("p"))
    paint = [F.coalesce(c(f"p._{k}"), F.lit(v)).alias(k) for k, v in zip("rgb", rgb, strict=True)]
    return g.select("capture_id", (c("x0") + c("a") * (c("x1") - c("x0")) / c("n")).alias("x"), c("h").alias("y"), (c("z0") + c("a") * (c("z1") - c("z0")) / c("n")).alias("z"), *paint)
