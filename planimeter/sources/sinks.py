"""Writers of documents and bundles; every file is written by the tasks that hold its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of odometry.csv in file order.
ODOMETRY = ("frame", "timestamp", "x", "y", "z", "qx", "qy", "qz", "qw", "fx", "fy", "cx", "cy")


def write_documents(files: DataFrame, path: str) -> None:
    """Rows of folder, name and content as text under folder=.../name=...; each row is a file's whole text."""
    files.select("content", "folder", "name").repartition("folder", "name").write.mode("overwrite").partitionBy("folder", "name").text(path)


def read_documents(spark, path: str) -> DataFrame:
    """What write_documents() wrote: folder, name, content."""
    text = spark.read.option("basePath", path).text(path, wholetext=True)
    return text.select(F.col("folder").cast("string"), F.col("name").cast("string"), F.rtrim(F.col("value"), F.lit("\n")).alias("content"))


def plan_files(docs: DataFrame, summaries: DataFrame, drawings: DataFrame) -> DataFrame:
    """plan.json, summary.txt and, where a plan has rooms, plan.svg of each capture, as rows of folder, name, content."""
    row = lambda t, name, c: t.select(F.col("capture_id").cast("string").alias("folder"), F.lit(name).alias("name"), F.rtrim(F.col(c), F.lit("\n")).alias("content"))
    return row(docs, "plan.json", "document").unionByName(row(summaries, "summary.txt", "summary")).unionByName(row(drawings, "plan.svg", "svg"))


def report_files(reports: DataFrame) -> DataFrame:
    """report.json and report.txt of each case, as rows of folder, name, content."""
    row = lambda name, c: reports.select(F.col("case_id").cast("string").alias("folder"), F.lit(name).alias("name"), F.rtrim(F.col(c), F.lit("\n")).alias("content"))
    return row("report.json", "report").unionByName(row("report.txt", "text"))


def bundle_frames(poses: DataFrame, depth: DataFrame, confidence: DataFrame, intrinsics: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Frames (capture_id, key) that have a pose (t, q), a depth picture, a confidence picture (content) and intrinsics
    (width, height, fx, fy, cx, cy), and the captures with under `least` of them, which are left out.

    Intrinsics are scaled to the 1920 x 1440 picture that readers of bundles expect."""
    on = ["capture_id", "key"]
    j = poses.join(depth.select(*on, F.col("content").alias("depth")), on).join(confidence.select(*on, F.col("content").alias("confidence")), on).join(intrinsics, on)
    few = poses.select("capture_id").distinct().join(j.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n")), "capture_id", "left").na.fill(0, ["n"]).where(F.col("n") < least)
    k = {n: F.col(n) * F.lit(size) / F.col(side) for n, size, side in (("fx", 1920.0, "width"), ("fy", 1440.0, "height"), ("cx", 1920.0, "width"), ("cy", 1440.0, "height"))}
    return j.withColumns(k).join(few.select("capture_id"), "capture_id", "left_anti").drop("width", "height"), few


def odometry_text(frames: DataFrame) -> DataFrame:
    """odometry.csv and camera_matrix.csv of bundle_frames(), as rows of folder, name, content."""
    c = F.col
    f = lambda v, n: F.format_string(f"%.{n}f", v)
    at = lambda a, i: F.get(a, F.lit(i))
    cells = [c("key"), c("key"), *[f(at("t", i), 6) for i in range(3)], *[f(at("q", i), 8) for i in range(4)], *[f(c(n), 6) for n in ("fx", "fy", "cx", "cy")]]
    line = F.struct(c("key").cast("double").alias("o"), F.concat_ws(",", *cells).alias("line"))
    first = F.min_by(F.struct("fx", "fy", "cx", "cy"), c("key").cast("double"))
    g = frames.groupBy("capture_id").agg(F.array_sort(F.collect_list(line)).alias("l"), first.alias("k"))
    table = F.concat(F.lit(",".join(ODOMETRY) + "\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    matrix = F.concat(f(c("k.fx"), 6), F.lit(", 0, "), f(c("k.cx"), 6), F.lit("\n0, "), f(c("k.fy"), 6), F.lit(", "), f(c("k.cy"), 6), F.lit("\n0, 0, 1"))
    each = F.explode(F.array(F.struct(F.lit("odometry.csv").alias("name"), table.alias("content")), F.struct(F.lit("camera_matrix.csv").alias("name"), matrix.alias("content")))).alias("f")
    return g.select(c("capture_id").cast("string").alias("folder"), each).select("folder", "f.*")
