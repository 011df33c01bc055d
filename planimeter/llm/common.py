"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word patterns, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session whose executors are threads of the driver
    (local master, as in tests) gets a folder of its own where it names none; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/planimeter-shared"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def drop_shuffles(spark: SparkSession) -> None:
    """Have files of shuffles that no plan refers to any more removed now; Spark does so when its driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand Python at most `rows` rows at a time from here on: whole texts make batches of the usual size large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def trim() -> None:
    """Give freed memory back to the system: a Python worker outlives its task and keeps what it does not return."""
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):
        release(0)


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def materialize(df: DataFrame, sort: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors.

    The files go when the driver's JVM ends, or earlier by release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/planimeter-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    fs, hadoop = _filesystem(spark, path)
    fs.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._planimeter_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove what materialize() wrote; only for frames no later plan reads."""
    for df in frames:
        if path := getattr(df, "_planimeter_path", None):
            fs, hadoop = _filesystem(df.sparkSession, path)
            fs.delete(hadoop, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, where a lambda would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs without white space. Null text: no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text, as long; null text: 0."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", "")
    pieces = F.split(trimmed, SPACE)
    return let(
        pieces,
        lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(
            F.size(p) - (F.element_at(p, -1) == "").cast("int")
        ),
    ).cast("long")


def by_group(
    batches: Iterator[pa.RecordBatch], key: str
) -> Iterator[pa.Table]:
    """Arrow batches sorted by key, as one table for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        start = 0
        for i in range(len(keys) + 1):
            if i < len(keys) and keys[i] == (keys[start] if i > start else current if held else keys[i]):
                continue
            if i > start:
                held.append(batch.slice(start, i - start))
                current = keys[start]
                start = i
            if i < len(keys):
                yield pa.Table.from_batches(held)
                held, current = [], keys[i]
    if held:
        yield pa.Table.from_batches(held)


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Components of an undirected graph by minimum label with pointer jumping.

    edges: columns u, v of any one ordered type; null ends, loops and repeats are allowed and ignored.
    Returns node, component (the least node reachable) for every node with an edge. All state stays
    distributed; each round is written to the shared folder, so it survives lost executors."""
    both = edges.where("u is not null and v is not null and u <> v")
    both = both.select("u", "v").unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = materialize(both)
    labels = materialize(
        both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component"))
    )
    for _ in range(rounds):
        heard = (
            both.join(labels.select(F.col("node").alias("v"), "component"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("component").alias("heard"))
        )
        stepped = labels.join(heard, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "heard").alias("near")
        )
        jumped = materialize(
            stepped.join(
                labels.select(F.col("node").alias("near"), F.col("component").alias("far")), "near"
            ).select("node", F.least("near", "far").alias("component"), (F.least("near", "far") != F.col("old")).alias("moved"))
        )
        moved = jumped.where("moved").limit(1).count()
        release(labels)
        labels = jumped
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    release(both)
    return labels.select("node", "component")
