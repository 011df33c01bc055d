"""Sharding by extendible hashing; DataFrame functions only.

The directory is indexed by the leading bits of a key's hash. It starts with one bucket; a bucket over
the byte limit splits on its next bit, and only such buckets split, until every shard fits. The splits run
over a table of bytes by cell (a cell is a prefix of CELL_BITS bits), not over the rows; only where a cell
itself is too large are its rows cut into finer cells. The bits of a key are followed by bits of the text, so that
rows of one key, however many, still split. Rows that share all bits are copies of one text: their bucket
gets overflow pages of as many rows as fit, numbered by salted parts, so no task orders a whole bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planimeter.llm.common import materialize, release

#: Bits by which cells get finer at a time, of a key's hash, and of all.
CELL_BITS, KEY_BITS, HASH_BITS = 12, 60, 120


def hash_bits(key: Column, text: Column) -> Column:
    """60 bits of the MD5 of the key's text as a string of 0s and 1s; a null key goes by its document's text."""
    name = F.coalesce(key.cast("string"), F.concat(F.lit("t"), text), F.lit(""))
    return F.lpad(F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 2), KEY_BITS, "0")


def _prefix(width: int) -> Column:
    """The first bits of a row's key hash and, beyond those, of its text's hash."""
    if width <= KEY_BITS:
        return F.substring("bits", 1, width)
    more = F.lpad(F.bin(F.shiftrightunsigned(F.coalesce("hash", F.lit(0)), 4)), HASH_BITS - KEY_BITS, "0")
    return F.concat("bits", F.substring(more, 1, width - KEY_BITS))


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """Buckets as prefix, depth, bytes, from rows of bits, hash and n_bytes."""
    found = []
    rest, start, width = sized, 0, CELL_BITS
    while True:
        cells = materialize(rest.groupBy(_prefix(width).alias("cell")).agg(F.sum("n_bytes").alias("bytes")))
        # One pass over the small cell table: the depth of a cell's bucket is the first whose sum fits.
        sums = []
        for depth in range(start, width + 1):
            sums.append(F.sum("bytes").over(Window.partitionBy(F.substring("cell", 1, depth))).alias(f"s{depth}"))
        wide = cells.select("cell", "bytes", *sums)
        depth = F.coalesce(*[F.when(F.col(f"s{d}") <= limit, F.lit(d)) for d in range(start, width + 1)])
        total = F.coalesce(*[F.when(F.col(f"s{d}") <= limit, F.col(f"s{d}")) for d in range(start, width + 1)])
        placed = materialize(wide.select("cell", depth.alias("depth"), F.coalesce(total, F.col("bytes")).alias("bytes")))
        release(cells)
        found.append(placed.where("depth is not null").select(F.expr("substring(cell, 1, depth)").alias("prefix"), "depth", "bytes").distinct())
        over = placed.where("depth is null").select(F.col("cell").alias("__cell"), F.col("bytes").alias("__bytes"))
        if width == HASH_BITS or not over.limit(1).count():
            found.append(over.select(F.col("__cell").alias("prefix"), F.lit(width).alias("depth"), F.col("__bytes").alias("bytes")))
            break
        # Rows of a cell that is too large share their first `same` bits. If they share all, its bucket is at the last bit;
        # the others split again from the first bit that parts any of them on.
        full = _prefix(HASH_BITS)
        rest = rest.join(over, _prefix(width) == F.col("__cell"), "left_semi")
        ends = rest.groupBy(_prefix(width).alias("__cell")).agg(F.min(full).alias("first"), F.max(full).alias("last"), F.sum("n_bytes").alias("bytes"))
        alike = F.filter(F.sequence(F.lit(1), F.lit(HASH_BITS)), lambda i: F.substring("first", F.lit(1), i) == F.substring("last", F.lit(1), i))
        ends = materialize(ends.withColumn("same", F.size(alike)))
        whole = ends.where(F.col("same") == HASH_BITS)
        found.append(whole.select(F.col("first").alias("prefix"), F.lit(HASH_BITS).alias("depth"), "bytes"))
        same = ends.where(F.col("same") < HASH_BITS).agg(F.min("same")).first()[0]
        if same is None:
            break
        rest = rest.join(whole.select("__cell"), _prefix(width) == F.col("__cell"), "left_anti")
        start, width = same + 1, min(HASH_BITS, same + CELL_BITS)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _paged(over: DataFrame, limit: int) -> DataFrame:
    """Adds page to rows of buckets that cannot split; a page holds at most limit bytes, or one longer document."""
    parts = 4 * int(over.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = over.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    sums = salted.groupBy("prefix", "salt").agg(F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("most"))
    ahead = Window.partitionBy("prefix").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.select(
        "prefix",
        "salt",
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"),
        F.greatest(F.lit(1), F.floor(limit / F.max("most").over(Window.partitionBy("prefix")))).alias("fit"),
    )
    nth = F.row_number().over(Window.partitionBy("prefix", "salt").orderBy("row")) - 1
    rows = salted.withColumn("nth", nth).join(places, ["prefix", "salt"])
    return rows.withColumn("page", F.floor((F.col("ahead") + F.col("nth")) / F.col("fit")).cast("long")).drop("salt", "nth", "ahead", "fit")


def _placed(df: DataFrame, row: Column, id_col: str, text_col: str, limit_bytes: int) -> DataFrame:
    """What shard_documents gives, and each row's own number in the column row."""
    sized = materialize(
        df.select(
            F.col(id_col).alias("doc_id"),
            hash_bits(F.col(id_col), F.col(text_col)).alias("bits"),
            F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
            F.xxhash64(text_col).alias("hash"),
            row.alias("row"),
        )
    )
    buckets = materialize(directory(sized, limit_bytes))
    depths = [r[0] for r in buckets.select("depth").distinct().collect()]  # at most 121 numbers
    placed = None
    for d in sorted(depths):
        side = buckets.where(F.col("depth") == d).select("prefix", "depth", F.col("bytes").alias("shard_bytes"))
        part = sized.withColumn("prefix", _prefix(d)).join(side, "prefix")
        placed = part if placed is None else placed.unionByName(part)
    if placed is None:
        placed = sized.withColumns({"prefix": F.lit(""), "depth": F.lit(0), "shard_bytes": F.lit(0).cast("long")})
    over = F.col("shard_bytes") > limit_bytes
    paged = _paged(placed.where(over), limit_bytes)
    return (
        placed.where(~over).withColumn("page", F.lit(0).cast("long")).unionByName(paged)
        .select("doc_id", "n_bytes", F.col("prefix").alias("shard"), F.col("depth").cast("long").alias("depth"), "page", "shard_bytes", "row")
    )


def shard_documents(df: DataFrame, *, id_col="doc_id", text_col="text", limit_bytes: int = 4_000_000) -> DataFrame:
    """One row a document: doc_id, n_bytes, shard (its bucket's prefix bits), depth, page, shard_bytes.

    n_bytes is the text's UTF-8 length (null: 0). page is 0 but in buckets that cannot split any further
    (copies of one key and text), where pages hold at most limit_bytes each, or one longer document. A null key
    goes by its text. An empty table gives no rows; other columns are not read."""
    return _placed(df, F.monotonically_increasing_id(), id_col, text_col, limit_bytes).drop("row")


def write_shards(df: DataFrame, path: str, *, id_col="doc_id", text_col="text", limit_bytes: int = 128_000_000) -> None:
    """Write df as one Parquet folder a page of a shard (shard=<prefix>/page=<number>); every row once."""
    # Rows are numbered once, so that each goes by its own page, whatever its key repeats.
    whole = materialize(df.withColumn("__row", F.monotonically_increasing_id()))
    pages = _placed(whole, F.col("__row"), id_col, text_col, limit_bytes).select(F.col("row").alias("__row"), "shard", "page")
    rows = whole.join(pages, "__row").drop("__row")
    rows.repartition("shard", "page").write.partitionBy("shard", "page").mode("overwrite").parquet(path)
    release(whole)
