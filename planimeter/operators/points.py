"""Operators on point tables: capture_id, ord, x, y, z, frame_index. Each works on all captures at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def voxel_downsample(points: DataFrame, voxel: float, axes=("x", "y", "z")) -> DataFrame:
    """The first point (least ord) of each voxel of each capture, with n, the points it stands for."""
    keys = [F.floor(F.col(a) / voxel).alias(f"k{a}") for a in axes]
    others = [c for c in points.columns if c != "capture_id"]
    first = F.min_by(F.struct(*others), F.col("ord")).alias("first")
    return points.groupBy("capture_id", *keys).agg(first, F.count(F.lit(1)).alias("n")).select(
        "capture_id", *[f"k{a}" for a in axes], "n", "first.*"
    )


def vertical_columns(points: DataFrame, cell: float = 0.05) -> DataFrame:
    """Points in (x, z) cells that are tall: spread 0.65, top 1.15, three returns between 0.45 and 1.6."""
    return upright(points, cell).where("vertical").drop("vertical")


def upright(points: DataFrame, cell: float = 0.05) -> DataFrame:
    """Points with vertical: whether their (x, z) cell is tall."""
    at = Window.partitionBy("capture_id", F.floor(F.col("x") / cell), F.floor(F.col("z") / cell))
    low, high = F.min("y").over(at), F.max("y").over(at)
    middle = F.count_if((F.col("y") > 0.45) & (F.col("y") < 1.6)).over(at)
    return points.withColumn("vertical", (high - low >= 0.65) & (high >= 1.15) & (middle >= 3))


def fence(points: DataFrame, axes=("x", "y", "z"), slack: float = 1.0, least: int = 30) -> DataFrame:
    """Points within slack of the 5th to 95th percentile on each axis; captures under `least` points stay whole."""
    cuts = points.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.percentile(a, F.array(F.lit(0.05), F.lit(0.95))).alias(f"_{a}") for a in axes]
    )
    inside = F.lit(True)
    for a in axes:
        inside = inside & F.col(a).between(F.col(f"_{a}")[0] - slack, F.col(f"_{a}")[1] + slack)
    return points.join(cuts, "capture_id").where((F.col("_n") < least) | inside).select(*points.columns)


def mode_height(points: DataFrame, keys: tuple[str, ...], low: Column, high: Column, *, bins: int, least: int, value: str = "y") -> DataFrame:
    """The centre of the fullest of `bins` bins laid over the values between low and high (columns per row of
    keys); ties go to the lower bin, groups under `least` values have none."""
    band = points.where((F.col(value) >= low) & (F.col(value) <= high))
    over = Window.partitionBy(*keys)
    ranged = band.withColumns({"_lo": F.min(value).over(over), "_hi": F.max(value).over(over), "_n": F.count(F.lit(1)).over(over)})
    ranged = ranged.where(F.col("_n") >= least).withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
    at = F.when(F.col("_w") > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")), F.lit(bins - 1))).otherwise(F.lit(0))
    counted = ranged.groupBy(*keys, at.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.first("_lo").alias("_lo"), F.first("_w").alias("_w"))
    best = counted.groupBy(*keys).agg(F.max_by(F.struct("_bin", "_lo", "_w", "_c"), F.struct(F.col("_c"), -F.col("_bin"))).alias("m"))
    return best.select(*keys, (F.col("m._lo") + (F.col("m._bin") + 0.5) * F.col("m._w")).alias("mode"), F.col("m._c").alias("n"))


def floor_mode(points: DataFrame, keys: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """Floor height: the mode of the values from p1 - 0.02 to p1 + 0.25 in 40 bins. Null (no row) under 80
    points, or 40 in the band."""
    base = points.groupBy(*keys).agg(F.percentile("y", 0.01).alias("_p1"), F.count(F.lit(1)).alias("_all")).where("_all >= 80")
    joined = points.join(base, list(keys))
    return mode_height(joined, keys, F.col("_p1") - 0.02, F.col("_p1") + 0.25, bins=40, least=40)


def chunk_drift(points: DataFrame, chunks: int = 4) -> DataFrame:
    """Shift of each quarter of a capture's frames: its floor mode, if it has 100 points and the mode is
    within 0.25, else 0. Quarters end at quantiles of frame_index; the last holds its end."""
    cuts = points.groupBy("capture_id").agg(F.percentile("frame_index", F.array(*[F.lit(i / chunks) for i in range(chunks + 1)])).alias("_q"))
    held = points.join(cuts, "capture_id")
    chunk = F.size(F.filter(F.slice("_q", 2, chunks - 1), lambda q: F.col("frame_index") >= q))
    held = held.withColumn("chunk", chunk)
    counts = held.groupBy("capture_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    modes = floor_mode(held, ("capture_id", "chunk")).select("capture_id", "chunk", "mode")
    good = (F.col("n") >= 100) & (F.abs("mode") <= 0.25)
    return counts.join(modes, ["capture_id", "chunk"], "left").withColumn("shift", F.when(good, F.col("mode")).otherwise(F.lit(0.0)))


def rigid_fit_2d(pairs: DataFrame) -> DataFrame:
    """Least-squares rotation and shift that takes (ax, az) to (bx, bz), one a capture; aggregates only."""
    s = pairs.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in ("ax", "az", "bx", "bz")],
        *[F.covar_pop(a, b).alias(f"{a}_{b}") for a in ("ax", "az") for b in ("bx", "bz")],
    )
    yaw = F.atan2(F.col("ax_bz") - F.col("az_bx"), F.col("ax_bx") + F.col("az_bz"))
    s = s.withColumn("yaw", yaw)
    c, d = F.cos("yaw"), F.sin("yaw")
    return s.select(
        "capture_id", "n", "yaw",
        (F.col("m_bx") - (c * F.col("m_ax") - d * F.col("m_az"))).alias("tx"),
        (F.col("m_bz") - (d * F.col("m_ax") + c * F.col("m_az"))).alias("tz"),
    )


def depth_points(pixels: DataFrame, poses: DataFrame, *, stride: int = 3, near: float = 0.25, far: float = 4.8, least: int = 40) -> DataFrame:
    """World points of depth pixels (capture_id, frame, v, u, mm, conf): confident and in range, frames with at
    least `least` of them, every third one in row order, moved by the pose of the frame. A frame without any
    confidence counts as confident; in one that has some, a pixel without is not."""
    from planimeter.functions.expr import backproject, rotate_by_quaternion

    z = F.col("mm") / 1000.0
    frame = Window.partitionBy("capture_id", "frame")
    sure = F.when(F.max("conf").over(frame).isNull(), F.lit(True)).otherwise(F.coalesce(F.col("conf") >= 2, F.lit(False)))
    good = pixels.withColumn("_sure", sure).where((z > near) & (z < far) & F.col("_sure"))
    kept = good.withColumns({"_n": F.count(F.lit(1)).over(frame), "_i": F.row_number().over(frame.orderBy("v", "u"))})
    kept = kept.where((F.col("_n") >= least) & ((F.col("_i") - 1) % stride == 0))
    moved = kept.join(poses, ["capture_id", "frame"]).withColumn("_c", backproject(F.col("u"), F.col("v"), z, *[F.col(c) for c in ("fx", "fy", "cx", "cy")]))
    moved = moved.withColumn("_w", rotate_by_quaternion(F.col("q"), F.col("_c")))
    return moved.select("capture_id", "frame", "v", "u", *[(F.col(f"_w.{a}") + F.col("t")[i]).alias(a) for i, a in enumerate("xyz")])


def spaced_poses(poses: DataFrame, spacing: float = 0.18, most: int = 90) -> DataFrame:
    """Usable poses kept: the first, then each at least `spacing` from the last kept; over `most` evenly spaced ones of
    them. One row a capture, indices in order.

    A fold over a capture's trajectory, which is some thousand poses at most."""
    from planimeter.functions.expr import pose_usable

    ordered = F.array_sort(F.collect_list(F.struct("pose_index", "t")))
    first = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(None).cast("array<double>").alias("last"))

    def step(acc: Column, p: Column) -> Column:
        d = F.sqrt(sum(((p["t"][i] - acc["last"][i]) ** 2 for i in range(3)), F.lit(0.0)))
        take = acc["last"].isNull() | (d >= spacing)
        return F.when(take, F.struct(F.concat(acc["kept"], F.array(p["pose_index"])).alias("kept"), p["t"].alias("last"))).otherwise(acc)

    usable = poses.where(pose_usable(F.col("t"), F.col("q"))).withColumn("pose_index", F.col("pose_index").cast("int"))
    kept = usable.groupBy("capture_id").agg(ordered.alias("p")).select("capture_id", F.aggregate("p", first, step)["kept"].alias("kept"))
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get("kept", F.floor(i * (F.size("kept") - 1) / F.lit(most - 1)).cast("int")))
    return kept.withColumn("kept", F.when(F.size("kept") > most, even).otherwise(F.col("kept")))
