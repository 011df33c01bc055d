"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

A projection (the leading directions where a vector is wider than `bits`) and a rotation are learned on a bounded
sample by alternating signs and orthogonal fits; a code holds the signs of a vector under them. Codes are split into
substrings of 16 bits, each indexed in a table of its own. If a code lies within radius = substrings * a + b bits of the
query's, one of the first b + 1 substrings differs in at most a bits or one of the others in at most a - 1 (the
pigeonhole principle), so probing the values that near in every table finds every code within the radius; what the
full code confirms is ranked by exact cosines. The radius is learned too: that which holds nearly all true
neighbours in the sample. Queries that find too few are searched again with a wider one.

Tables are sharded by the first bits of their substring. A query goes only to the shards whose bits
are within reach of its own, and there to the values its remaining bits can reach; a code found through
several tables counts in the first. Large shards and their queries are split into parts of bounded size, so neither
side is ever broadcast. Equal vectors are one entry with their smallest keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planimeter.llm.common import materialize, trim

#: Rows the rotation and the radius are fitted on, entries of a shard's part, queries of a task.
SAMPLE, SHARD, BLOCK = 10_000, 4096, 8192
#: Bits of a code and of a substring.
BITS, SUB = 64, 16
POPCOUNT = np.bitwise_count(np.arange(1 << SUB, dtype=np.uint16)).astype(np.uint8)


@dataclass
class Model:
    centre: np.ndarray
    turn: np.ndarray
    radius: int

    @property
    def tables(self) -> int:
        return -(-self.turn.shape[1] // SUB)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes of unit vectors, as rows of substrings."""
        signs = (x - self.centre) @ self.turn > 0
        packed = np.packbits(np.pad(signs, ((0, 0), (0, -signs.shape[1] % SUB))), axis=1)
        return packed.view(">u2").astype(np.uint16).reshape(len(x), self.tables)

    def reach(self, radius: int) -> np.ndarray:
        """Bits in which a substring of each table may differ, so that every code within radius is found."""
        a, b = divmod(radius, self.tables)
        return np.where(np.arange(self.tables) <= b, a, a - 1)


def fit(x: np.ndarray, k: int = 5, bits: int = BITS, rounds: int = 25, seed: int = 6, recall: float = 0.985) -> Model:
    """Projection, rotation and radius from unit vectors x."""
    rng = np.random.default_rng(seed)
    centre = x.mean(axis=0)
    basis = np.eye(x.shape[1])
    if x.shape[1] > bits:
        basis = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :bits]
    flat = (x - centre) @ basis
    r = np.linalg.qr(rng.standard_normal((flat.shape[1], flat.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(flat @ r).T @ flat)
        r = (u @ vt).T
    model = Model(centre, basis @ r, 0)
    codes = model.codes(x)
    distances = []
    for i in rng.permutation(len(x))[:400]:
        cosines = x @ x[i]
        cosines[i] = -2
        near = np.argsort(-cosines, kind="stable")[:k]
        distances += list(POPCOUNT[codes[near] ^ codes[i]].sum(axis=1, dtype=int))
    model.radius = int(np.quantile(distances, recall)) if distances else 0
    return model


class Index:
    """One shard of a table: codes whose substring starts with the same bits, by the value of its other bits."""

    def __init__(self, codes: np.ndarray, table: int, prefix: int, prefix_bits: int):
        self.codes, self.table, self.prefix, self.low = codes, table, prefix, SUB - prefix_bits
        values = codes[:, table] & np.uint16((1 << self.low) - 1)
        self.order = np.argsort(values, kind="stable")
        self.starts = np.searchsorted(values[self.order], np.arange((1 << self.low) + 1))
        masks = np.arange(1 << self.low, dtype=np.uint16)
        self.masks = [masks[POPCOUNT[masks] <= r] for r in range(self.low + 1)]

    def within(self, code: np.ndarray, radius: int, reach: np.ndarray) -> np.ndarray:
        """Rows whose code differs from code in at most radius bits and that no earlier table finds."""
        mine = int(code[self.table])
        left = int(reach[self.table]) - int(POPCOUNT[(mine >> self.low) ^ self.prefix])
        if left < 0:
            return np.zeros(0, np.int64)
        probes = self.masks[min(left, self.low)] ^ np.uint16(mine & ((1 << self.low) - 1))
        start = self.starts[probes]
        size = self.starts[probes + np.int64(1)] - start
        rows = self.order[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        apart = POPCOUNT[self.codes[rows] ^ code]
        earlier = (apart[:, : self.table] <= reach[: self.table]).any(axis=1)
        return rows[(apart.sum(axis=1, dtype=int) <= radius) & ~earlier]


def valid(vector: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    """Rows of a column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / _norms(x)[:, None]


def _places(model: Model, prefix_bits: int, radius: int | None):
    """Adds to each row the shards (table, prefix) it belongs to, or with a radius those a query has to probe."""
    prefixes = np.arange(1 << prefix_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = model.codes(_unit(_matrix(batch.column(1))))
            heads = codes.astype(np.int64) >> (SUB - prefix_bits)
            if radius is None:
                places = [[(t, int(h)) for t, h in enumerate(row)] for row in heads]
            else:
                reach = model.reach(radius)
                places = [[(t, int(p)) for t, h in enumerate(row) for p in prefixes[POPCOUNT[prefixes ^ h] <= reach[t]]] for row in heads]
            shards = pa.array([[t << SUB | p for t, p in row] for row in places], pa.list_(pa.int32()))
            yield pa.record_batch({"name": batch.column(0), "vector": batch.column(1), "shards": shards})

    return run


def _search(model: Model, prefix_bits: int, radius: int, k: int):
    schema = pa.schema([("q", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def run(key, entries: pa.Table, queries: pa.Table) -> pa.Table:
        if not entries.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, asked = _matrix(entries.column("vector")), _matrix(queries.column("vector"))
        x_norm, q_norm = _norms(x), _norms(asked)
        table, prefix = divmod(key[0].as_py(), 1 << SUB)
        index = Index(model.codes(x / x_norm[:, None]), table, prefix, prefix_bits)
        codes, reach = model.codes(asked / q_norm[:, None]), model.reach(radius)
        at, rows, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i in range(len(asked)):
            near = index.within(codes[i], radius, reach)
            score = np.einsum("ij,j->i", x[near], asked[i]) / (x_norm[near] * q_norm[i])
            if len(near) > k + 1:
                # All that tie with the last place stay: which key is smaller is seen later.
                least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                near, score = near[score >= least], score[score >= least]
            at.append(np.full(len(near), i))
            rows.append(near)
            scores.append(score)
        out = {"q": queries.column("q").take(pa.array(np.concatenate(at))), "ids": entries.column("ids").take(pa.array(np.concatenate(rows))), "score": pa.array(np.concatenate(scores))}
        trim()
        return pa.table(out).cast(schema)

    return run


def _found(model: Model, entries: DataFrame, queries: DataFrame, prefix_bits: int, radius: int, k: int) -> DataFrame:
    """q, ids, score: of each query the k + 1 best entries (or more, in a tie) of each shard within the radius."""
    shards = F.explode("shards").alias("shard")
    left = entries.mapInArrow(_places(model, prefix_bits, None), "name array<long>, vector array<double>, shards array<int>")
    right = queries.mapInArrow(_places(model, prefix_bits, radius), "name long, vector array<double>, shards array<int>")
    left, right = materialize(left.withColumnRenamed("name", "ids")), materialize(right.withColumnRenamed("name", "q"))
    held = left.select(shards).groupBy("shard").agg(F.count(F.lit(1)).alias("e"))
    asked = right.select(shards).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    parts = held.join(asked, "shard").select("shard", F.ceil(F.col("e") / SHARD).cast("int").alias("parts"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    parts = materialize(parts)  # at most tables x 2 ** prefix_bits rows, one for 4096 entries or more
    deal = lambda c: F.pmod(F.xxhash64("vector"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = left.select("ids", "vector", shards).join(F.broadcast(parts), "shard").select("shard", "ids", "vector", deal("parts").cast("int").alias("part"), every("blocks").alias("block"))
    right = right.select("q", "vector", shards).join(F.broadcast(parts.toDF(*parts.columns)), "shard").select("shard", "q", "vector", deal("blocks").cast("int").alias("block"), every("parts").alias("part"))
    by = ("shard", "part", "block")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search(model, prefix_bits, radius, k), "q long, ids array<long>, score double")


def nearest(
    df: DataFrame, queries: DataFrame, *, id_col="vec_id", vector_col="embedding", k: int = 5, bits: int = BITS, sample: int = SAMPLE
) -> DataFrame:
    """The k nearest rows of df by cosine for each row of queries: query_id, rank, vec_id, score.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those
    of another length than most of the sample. Rows with a null key take no part. A row is no candidate of
    a query of its own key; rows that repeat key and vector count once. Ties go to the smaller key. Fewer
    candidates than k: all are returned; none: no rows. Other columns are not read.

    The model is fitted on at most `sample` rows, those with the smallest hash of their key."""
    spark = df.sparkSession

    def clean(t: DataFrame) -> DataFrame:
        picked = t.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return picked.where(F.col("id").isNotNull() & valid(F.col("vector")))

    rows = clean(df)
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().column("vector")  # bounded by sample
    if not len(chosen):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = np.array([len(v) for v in chosen])
    width = int(np.bincount(lengths).argmax())
    model = fit(_unit(_matrix(chosen.filter(pa.array(lengths == width)))), k, bits)
    of_width = F.size("vector") == width
    alike = Window.partitionBy("vector").orderBy("id")
    entries = (
        rows.where(of_width).withColumn("n", F.dense_rank().over(alike)).where(F.col("n") <= k + 1)
        .groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    )
    entries = materialize(entries.select("ids", "vector"))
    asked = materialize(clean(queries).where(of_width).select("id", "vector"))
    distinct = materialize(asked.select("vector").distinct().select(F.monotonically_increasing_id().alias("q"), "vector"))
    n = entries.count()
    prefix_bits = min(SUB - 4, max(0, (n // SHARD).bit_length()))
    most, radius, left, found = SUB * model.tables, model.radius, distinct, None
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.element_at("ids", 1))
    while True:
        hits = _found(model, entries, left, prefix_bits, radius, k)
        hits = materialize(hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1))
        enough = hits.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k + 1, n)).select("q")
        whole = hits if radius >= most else hits.join(enough, "q")
        found = whole if found is None else found.unionByName(whole)
        if radius >= most:
            break
        left = materialize(left.join(enough, "q", "left_anti"))
        if not left.limit(1).count():
            break
        radius = min(most, radius + max(1, most // 8))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    named = asked.dropDuplicates(["id", "vector"]).join(distinct, "vector").select(F.col("id").alias("query_id"), "q", F.struct("id", "q").alias("query_row"))
    return (
        named.join(found, "q").select("query_id", "query_row", F.explode("ids").alias("vec_id"), "score")
        .where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
