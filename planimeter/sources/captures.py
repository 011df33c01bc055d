"""Readers of capture bundles. Many captures are read at once; capture_id is a folder's name."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Odometry columns in file order; image endings of stills.
ODOMETRY = ("timestamp", "frame", "x", "y", "z", "qx", "qy", "qz", "qw", "fx", "fy", "cx", "cy")
STILLS = (".jpg", ".jpeg", ".png")


def read_odometry(spark: SparkSession, paths: str | list[str], intrinsics: DataFrame | None = None) -> DataFrame:
    """Poses from odometry.csv files: capture_id, pose_index (file order), frame, ts, t, q, fx, fy, cx, cy.

    Columns go by the header's names, in any order; a space may follow each comma. Blank intrinsics take those of the
    capture's camera matrix, if given. A file is read whole, so its order is that of its lines."""
    text = spark.read.text(paths, wholetext=True).withColumn("capture_id", F.element_at(F.split(F.input_file_name(), "/"), -2))
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    cells = lambda x: F.transform(F.split(x, ","), lambda c: F.trim(c))
    rows = text.select("capture_id", cells(F.get(lines, F.lit(0))).alias("_names"), F.posexplode(F.slice(lines, 2, F.size(lines))).alias("pose_index", "_line"))
    rows = rows.withColumn("_c", F.map_from_arrays("_names", F.slice(cells(F.col("_line")), 1, F.size("_names"))))
    text_of = lambda n: F.nullif(F.try_element_at("_c", F.lit(n)), F.lit(""))
    v = {n: text_of(n).try_cast("double") for n in ODOMETRY if n != "frame"}
    poses = rows.select(
        "capture_id", "pose_index", text_of("frame").alias("frame"), v["timestamp"].alias("ts"), F.array(v["x"], v["y"], v["z"]).alias("t"), F.array(*[v[n] for n in ("qx", "qy", "qz", "qw")]).alias("q"),
        *[v[n].alias(n) for n in ("fx", "fy", "cx", "cy")],
    )
    if intrinsics is None:
        return poses
    k = intrinsics.select("capture_id", *[F.col(c).alias(f"_{c}") for c in ("fx", "fy", "cx", "cy")])
    return poses.join(k, "capture_id", "left").withColumns({c: F.coalesce(c, f"_{c}") for c in ("fx", "fy", "cx", "cy")}).drop("_fx", "_fy", "_cx", "_cy")


def read_intrinsics(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Camera matrices (3 x 3, no header): capture_id, fx, fy, cx, cy; other shapes are left out."""
    text = spark.read.text(paths, wholetext=True).withColumn("capture_id", F.element_at(F.split(F.input_file_name(), "/"), -2))
    rows = F.filter(F.split("value", r"\r?\n"), lambda r: F.trim(r) != "")
    numbers = F.transform(F.flatten(F.transform(rows, lambda r: F.split(r, ","))), lambda c: F.trim(c).try_cast("double"))
    k = text.select("capture_id", numbers.alias("k")).where((F.size("k") == 9) & ~F.exists("k", lambda x: x.isNull()))
    return k.select("capture_id", F.col("k")[0].alias("fx"), F.col("k")[4].alias("fy"), F.col("k")[2].alias("cx"), F.col("k")[5].alias("cy"))


def gravity(imu: DataFrame, rows: int = 4001) -> DataFrame:
    """Median length of the first 4001 accelerations (in g) of each capture: capture_id, row_ord, a_x, a_y, a_z."""
    norm = F.sqrt(F.col("a_x") ** 2 + F.col("a_y") ** 2 + F.col("a_z") ** 2)
    return imu.where(F.col("row_ord") < rows).groupBy("capture_id").agg(F.percentile(norm, 0.5).alias("g"))


def rotation_vector(axis: Column, v: Column) -> Column:
    """v (array of three) turned by a rotation vector (axis times angle)."""
    angle = F.sqrt(F.aggregate(axis, F.lit(0.0), lambda s, x: s + x * x))
    k = [F.when(angle > 0, F.get(axis, F.lit(i)) / angle).otherwise(0.0) for i in range(3)]
    p = [F.get(v, F.lit(i)) for i in range(3)]
    dot = k[0] * p[0] + k[1] * p[1] + k[2] * p[2]
    cross = [k[1] * p[2] - k[2] * p[1], k[2] * p[0] - k[0] * p[2], k[0] * p[1] - k[1] * p[0]]
    return F.array(*[p[i] * F.cos(angle) + cross[i] * F.sin(angle) + k[i] * dot * (1 - F.cos(angle)) for i in range(3)])


def read_trajectory(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Camera poses of text trajectories (time, axis-angle and translation from world to camera, z up): capture_id, key (time
    to three decimals), ts, t (camera centre), q (camera to world), both with y up.

    A line of another shape is left out; of two lines of one time the later stays."""
    text = spark.read.text(paths, wholetext=True).withColumn("capture_id", F.element_at(F.split(F.input_file_name(), "/"), -2))
    raw = text.select("capture_id", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    n = F.transform(F.split(F.trim("value"), r"\s+"), lambda c: c.try_cast("double"))
    p = raw.select("capture_id", "line", n.alias("n")).where((F.size("n") == 7) & ~F.exists("n", lambda x: x.isNull()))
    p = p.withColumn("key", F.format_string("%.3f", F.bround(F.col("n")[0], 3)))
    p = p.groupBy("capture_id", "key").agg(F.max_by("n", "line").alias("n"))
    back = F.transform(F.slice("n", 2, 3), lambda x: -x)
    centre = F.transform(rotation_vector(back, F.slice("n", 5, 3)), lambda x: -x)
    # The inverse turn as a quaternion, then a quarter turn about x that takes z up to y up.
    angle = F.sqrt(F.aggregate(back, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(angle > 0, F.sin(angle / 2) / angle).otherwise(0.5)
    x, y, z, w = (*(F.get(back, F.lit(i)) * unit for i in range(3)), F.cos(angle / 2))
    h = math.sqrt(0.5)
    q = F.array(h * x - h * w, h * y + h * z, h * z - h * y, h * w + h * x)
    t = F.array(F.get(centre, F.lit(0)), F.get(centre, F.lit(2)), -F.get(centre, F.lit(1)))
    return p.select("capture_id", "key", F.col("key").cast("double").alias("ts"), t.alias("t"), q.alias("q"))


def classify(listing: DataFrame) -> DataFrame:
    """Kind of each capture from its files (capture_id, path; a file right under the capture's folder is its root's):
    photo_property, video, lidar_bundle, photo_folder or unknown. A capture that is one mp4 file is a video.

    A sketch without a depth folder makes a property; depth pictures need poses; two stills in the root make a folder of
    photos."""
    p = F.col("path")
    here = F.concat(F.lit("/"), F.col("capture_id").cast("string"), F.lit("/"))
    own = F.when(p.contains(here), F.element_at(F.split(p, F.concat(F.lit("\\Q"), here, F.lit("\\E"))), -1)).otherwise(p)
    l = listing.withColumn("_p", own)
    q = F.col("_p")
    root = ~q.contains("/")
    has = lambda c, n: F.bool_or(c).alias(n)
    g = l.groupBy("capture_id").agg(
        has(q == "adjacency.json", "adjacency"), has(q.startswith("depth/"), "folder"), has(q.rlike(r"^depth/[^/]+\.png$"), "depth"), has(root & q.endswith(".mp4"), "video"),
        has(q == "odometry.csv", "odometry"), F.count_if(root & F.lower(q).rlike(r"\.(jpg|jpeg|png)$")).alias("stills"),
    )
    kind = (
        F.when(F.col("adjacency") & ~F.col("folder"), "photo_property").when(F.col("depth") & F.col("odometry"), "lidar_bundle")
        .when(F.col("video") | F.col("odometry"), "video").when(F.col("stills") >= 2, "photo_folder").otherwise("unknown")
    )
    return g.select("capture_id", kind.alias("kind"))


def stills(listing: DataFrame) -> DataFrame:
    """Pictures among files (capture_id, path relative to the capture) of its root, in order of names: capture_id, ord, path.
    Names that start with a dot are left out."""
    p = F.col("path")
    s = listing.where(~p.contains("/") & ~p.startswith(".") & F.lower(p).rlike(r"\.(jpg|jpeg|png)$"))
    return s.select("capture_id", (F.row_number().over(Window.partitionBy("capture_id").orderBy("path")) - 1).alias("ord"), "path")


def room_folders(listing: DataFrame) -> DataFrame:
    """Folders right under a capture that hold stills or a wall specification: capture_id, room_id, n_stills, specified."""
    parts = F.split("path", "/")
    name = F.get(parts, F.lit(1))
    own = listing.where(F.size(parts) == 2).select("capture_id", F.get(parts, F.lit(0)).alias("room_id"), name.alias("_n"))
    still = ~F.col("_n").startswith(".") & F.lower("_n").rlike(r"\.(jpg|jpeg|png)$")
    g = own.groupBy("capture_id", "room_id").agg(F.count_if(still).alias("n_stills"), F.max(F.col("_n") == "synthetic_walls.json").alias("specified"))
    return g.where((F.col("n_stills") > 0) | F.col("specified"))


def video_file(listing: DataFrame) -> DataFrame:
    """The film of each capture: rgb.mp4, video.mp4, walkthrough.mp4 or the first other mp4 of its root: capture_id, path."""
    p = F.col("path")
    rank = F.when(p == "rgb.mp4", 0).when(p == "video.mp4", 1).when(p == "walkthrough.mp4", 2).otherwise(3)
    return listing.where(~p.contains("/") & p.endswith(".mp4")).groupBy("capture_id").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


def wall_specs(docs: DataFrame) -> DataFrame:
    """Rectangles of wall specifications (capture_id, room_id, doc): capture_id, room_id, x0, z0, x1, z1, height_m (2.5 where
    missing); only documents marked as fixtures."""
    d = docs.select("capture_id", "room_id", F.from_json("doc", "struct<synthetic_fixture:boolean,x0:double,z0:double,x1:double,z1:double,height_m:double>").alias("d")).where("d.synthetic_fixture")
    return d.select("capture_id", "room_id", "d.x0", "d.z0", "d.x1", "d.z1", F.coalesce("d.height_m", F.lit(2.5)).alias("height_m"))


def frame_number(frame: Column) -> Column:
    """The number a frame's name says, null if it says none."""
    return F.trim(frame).try_cast("int")


def _unfiltered(line: bytes, up: bytes, size: int, how: int) -> list[int]:
    """A picture row of filter 3 (mean) or 4 (the nearest of left, above and corner to their plane): each byte needs the
    one before, so this is a plain loop over numbers."""
    made = [0] * size + list(line)
    above = bytes(size) + up
    if how == 3:
        for x in range(size, len(made)):
            made[x] = (made[x] + ((made[x - size] + above[x]) >> 1)) & 255
        return made[size:]
    for x in range(size, len(made)):
        left, top, corner = made[x - size], above[x], above[x - size]
        away = left + top - corner
        by_left, by_top, by_corner = abs(away - left), abs(away - top), abs(away - corner)
        best = left if by_left <= by_top and by_left <= by_corner else top if by_top <= by_corner else corner
        made[x] = (made[x] + best) & 255
    return made[size:]


def read_depth_png(files: DataFrame) -> DataFrame:
    """Pixels of 16- or 8-bit grey PNG files (columns capture_id, frame, content): capture_id, frame, v, u, value."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                data, at, packed = row["content"], 8, b""
                while at < len(data):
                    n, kind = struct.unpack(">I4s", data[at : at + 8])
                    body = data[at + 8 : at + 8 + n]
                    if kind == b"IHDR":
                        width, height, depth, colour = struct.unpack(">IIBB", body[:10])
                        if colour or depth not in (8, 16):
                            raise ValueError("only grey images of 8 or 16 bits are read")
                    elif kind == b"IDAT":
                        packed += body
                    at += 12 + n
                size = depth // 8
                lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * size)
                out = np.zeros((height + 1, width * size), np.uint8)
                for y in range(height):
                    how, line, up = lines[y, 0], lines[y, 1:], out[y]
                    if how == 0:
                        out[y + 1] = line
                    elif how == 2:
                        out[y + 1] = line + up
                    elif how == 1:
                        for k in range(size):
                            out[y + 1, k::size] = np.cumsum(line[k::size], dtype=np.uint8)
                    else:
                        out[y + 1] = _unfiltered(bytes(line), bytes(up), size, how)
                values = out[1:].reshape(-1).view(">u2" if size == 2 else np.uint8).astype(np.int32)
                n = width * height
                yield pa.record_batch({
                    "capture_id": pa.array([row["capture_id"]] * n, pa.string()), "frame": pa.array([row["frame"]] * n, pa.string()),
                    "v": pa.array(np.repeat(np.arange(height, dtype=np.int32), width)), "u": pa.array(np.tile(np.arange(width, dtype=np.int32), height)), "value": pa.array(values),
                })

    return files.select("capture_id", "frame", "content").mapInArrow(run, "capture_id string, frame string, v int, u int, value int")
