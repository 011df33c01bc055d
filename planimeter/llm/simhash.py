"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is `words` x 8 bytes. Two fingerprints that differ in at most d bits agree in at least
8 * words - d of their positional bytes. The index therefore lists fingerprints under groups of
positional bytes, such that any pair reaching that minimum shares at least one list (a covering design;
for wide fingerprints disjoint groups, which find nearly all pairs). Within a list shared positional bytes
are tallied, pairs below the minimum fall out, and the rest are verified bit by bit.

deduplicated() asks for a similarity of sets, not of bits: beside the index it has lists that go by least hashes of the
sets, for pairs farther apart in bits, wide fingerprints bound what these give, and within components of candidates the sets are compared exactly.

Copies collapse first: lists hold distinct fingerprints. A list never emits all its pairs: it is searched
outwards from one member at a time over the members not reached yet, and emits one edge for each member
reached. Lists over LIST_BLOCK members are searched in blocks, every pair of blocks by a task of its own,
so no link is lost and no task holds more than two blocks; a pair emits only edges that join components of
one block, so edges grow with a list's members, not with its pairs of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planimeter.llm.common import by_group, connected_components, materialize, release, small_batches, trim

#: Members of a list that one task searches against as many others, and bytes of their sets on average.
LIST_BLOCK, SET_BYTES = 512, 16_000_000
#: Near-copies have four of five shingles in common, or more.
SIMILAR = (4, 5)
#: Lists of deduplicated(): keys a set has, and least hashes in a key; their functions are fixed.
BANDS, BAND_ROWS = 32, 4
FACTORS, SHIFTS = np.random.default_rng(11).integers(0, 2**64, (2, BANDS * BAND_ROWS), np.uint64) | np.uint64(1)


def _shingles(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a text's shingles in their order; a text of fewer words is one, without words none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    if len(tokens) <= shingle:
        parts = [joined]
    else:
        starts = [0, *ends]
        parts = [joined[a : b - 1] for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), dtype=np.uint64, count=len(parts))


def _simhash(h: np.ndarray, words: int) -> bytes:
    n = len(h)
    if not n:
        return bytes(8 * words)
    out = []
    for k in range(words):
        if k:
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * k + 1)
            h ^= h >> np.uint64(29)
        counts = np.zeros(64, np.int64)
        for at in range(0, n, 8192):
            bits = np.unpackbits(h[at : at + 8192].astype(">u8").view(np.uint8)).reshape(-1, 64)
            counts += np.add.reduce(bits, axis=0, dtype=np.int64)
        out.append(np.packbits((2 * counts > n).astype(np.uint8)).tobytes())
    return b"".join(out)


def fingerprint(text: str | None, shingle: int = 4, words: int = 1) -> bytes:
    """The fingerprint of one text: `words` big-endian 64-bit SimHashes; no words: all zero."""
    return _simhash(_shingles(text, shingle), words)


def _list_keys(h: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of hashes, each of the least values of the set under BAND_ROWS hash functions."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        x = h[at : at + 1024, None] * FACTORS + SHIFTS
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0), out=least)
    raw, width = least.tobytes(), 8 * BAND_ROWS
    return np.array([xxhash.xxh64_intdigest(raw[i : i + width]) for i in range(0, len(raw), width)], np.uint64).view(np.int64)


def covering(positions: int, minimum: int) -> list[tuple[int, ...]]:
    """Groups of three positions of eight such that any four positions hold a group (twenty of them).

    The positions are split into two fours; a group is three within one part, or two in one part that
    form one of a fixed kind of pair and one position beyond. Found greedily from all triples."""
    if positions != 8 or minimum < 4:
        raise ValueError("a covering exists here for eight positions and four matches or more")
    need = set(combinations(range(positions), 4))
    groups = []
    while need:
        best = max(combinations(range(positions), 3), key=lambda g: (sum(set(g) <= set(q) for q in need), [-x for x in g]))
        groups.append(best)
        need = {q for q in need if not set(best) <= set(q)}
    return groups


Near = Callable[[int, np.ndarray], np.ndarray]


def _near_bits(fps: np.ndarray, max_bits: int, least: int) -> Near:
    """Which of the rows `left` of fps (rows of bytes) differ from row x in max_bits or fewer."""
    words = np.ascontiguousarray(fps).view(np.uint64)

    def near(x: int, left: np.ndarray) -> np.ndarray:
        out = np.ones(len(left), bool) if least <= 0 else (fps[left] == fps[x]).sum(axis=1) >= least
        at = np.flatnonzero(out)
        out[at] = np.bitwise_count(words[left[at]] ^ words[x]).sum(axis=1) <= max_bits
        return out

    return near


def _near_sets(sets: list[np.ndarray]) -> Near:
    """Which of the sets `left` have a Jaccard similarity of SIMILAR or more with set x, exactly."""
    sizes = np.array([len(s) for s in sets])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(at, kind="stable")]
    start = np.concatenate([[0], np.cumsum(n)])
    top, bottom = SIMILAR

    def near(x: int, left: np.ndarray) -> np.ndarray:
        holders = [owner[start[t] : start[t + 1]] for t in at[ends[x] : ends[x + 1]]]
        common = np.bincount(np.concatenate([*holders, owner[:0]]), minlength=len(sets))[left]
        return (top + bottom) * common >= top * (sizes[x] + sizes[left])

    return near


def _reach(left: np.ndarray, near: Near) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the link graph among the rows left."""
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(x, left)
            if hit.any():
                for y in left[hit]:
                    yield x, y
                queue.extend(left[hit])
                left = left[~hit]


def _joining(side: np.ndarray, near: Near) -> Iterator[tuple[int, int]]:
    """Edges that join the components of two blocks, which their own tasks connect within."""
    root = list(range(len(side)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for block in np.unique(side):
        for x, y in _reach(np.flatnonzero(side == block), near):
            root[find(x)] = find(y)
    for x, y in _reach(np.arange(len(side)), near):
        a, b = find(x), find(y)
        if a != b:
            root[a] = b
            yield x, y


def _search(near_of: Callable[[list[bytes], list[bytes]], Near]):
    """Edges u, v of each task; near_of makes its test from the names (column fp) and values of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us: list[bytes] = []
        vs: list[bytes] = []
        for group in by_group(batches, "task"):
            if group.num_rows < 2:
                continue
            # In one order everywhere, so that lists that share members give the same edges.
            rows = sorted(zip(*[group.column(c).to_pylist() for c in ("fp", "mine", "value")], strict=True), key=lambda r: r[0])
            raw, side = [x[0] for x in rows], np.array([x[1] for x in rows])
            near = near_of(raw, [x[2] for x in rows])
            first, other = group.column("task")[0].as_py().split(":")[1:]
            for x, y in _reach(np.arange(len(raw)), near) if first == other else _joining(side, near):
                us.append(raw[x])
                vs.append(raw[y])
            if len(us) >= 50_000:
                yield pa.record_batch({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})
                us, vs = [], []
        yield pa.record_batch({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return run


def _bytes_of(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def _links(lists: DataFrame, near_of: Callable[[list[bytes], list[bytes]], Near], block: int) -> DataFrame:
    """Edges u, v that connect the links within each list; lists: key (binary), fp, value."""
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes")).where("n > 1")
    parts = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / F.lit(block)), F.ceil(F.col("bytes") / F.lit(SET_BYTES)))).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        lists.join(sizes, "key")
        .withColumn("parts", parts)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.concat(F.hex("key"), F.lit(":"), F.least("mine", "other").cast("string"), F.lit(":"), F.greatest("mine", "other").cast("string")).alias("task"),
            "fp",
            "mine",
            "value",
        )
    )
    n = max(1, int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(n, "task").sortWithinPartitions("task").mapInArrow(_search(near_of), "u binary, v binary")


def fingerprint_links(fps: DataFrame, *, words: int, max_bits: int, block: int = LIST_BLOCK) -> DataFrame:
    """Edges u, v among distinct fingerprints (column fp, binary) that connect all links of max_bits or fewer."""
    if words == 1:
        groups, least = covering(8, 8 - max_bits), 8 - max_bits
    else:
        groups, least = [(2 * i, 2 * i + 1) for i in range(4 * words)], max(2, 8 * words - max_bits)
    keys = [
        F.concat(F.lit(bytes([i])), *[F.substring(F.col("fp"), p + 1, 1) for p in g]) for i, g in enumerate(groups)
    ]
    lists = fps.select(F.explode(F.array(*keys)).alias("key"), "fp", F.lit(None).cast("binary").alias("value"))
    return _links(lists, lambda raw, _: _near_bits(_bytes_of(raw), max_bits, least), block)


def _fingerprints(shingle: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, words) for t in batch.column(1)]
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(fps, pa.binary())})

    return run


def simhash_components(
    df: DataFrame, *, id_col="doc_id", text_col="text", shingle=4, words=1, max_bits=4
) -> DataFrame:
    """One row a document: doc_id, fp (binary), component_id.

    component_id is the smallest non-null key reachable through links of max_bits differing bits or
    fewer, the document's own included; null where no reachable document has a key. Null, empty and blank
    texts have the zero fingerprint and link like any other. Documents of the same fingerprint are one
    node, so repeated rows and repeated keys are kept as they are. Keys must be whole numbers. An empty
    table gives no rows; other columns are not read."""
    small_batches(df.sparkSession)
    bare = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = materialize(bare.mapInArrow(_fingerprints(shingle, words), "doc_id long, fp binary"))
    nodes = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = materialize(fingerprint_links(nodes.select("fp"), words=words, max_bits=max_bits))
    parts = connected_components(links)
    member = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    member = materialize(member)
    named = member.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = member.join(named, "component").select("fp", "component_id")
    release(links)
    return docs.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; a text of fewer words is one shingle, a blank one has none."""
    return np.unique(_shingles(text, shingle))


def _marks(shingle: int, words: int):
    """Adds to each row node (its set of shingles, hashed), fp (the fingerprint of the set) and keys of its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, keys = [], [], []
            for t in batch.column(batch.schema.get_field_index("__text")):
                h = shingle_set(t.as_py(), shingle)
                nodes.append(xxhash.xxh3_128_digest(h.tobytes()))
                fps.append(_simhash(h, words))
                keys.append(_list_keys(h))
            at = pa.array(np.arange(0, BANDS * len(keys) + 1, BANDS), pa.int32())
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != "__text"}
            columns |= {"__node": pa.array(nodes, pa.binary()), "__fp": pa.array(fps, pa.binary())}
            yield pa.record_batch(columns | {"__keys": pa.ListArray.from_arrays(at, pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))})
            trim()

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(2)]
            yield pa.record_batch({"key": batch.column(0), "fp": batch.column(1), "value": pa.array(sets, pa.binary())})

    return run


def indexed_candidates(nodes: DataFrame, *, max_bits: int = 4, block: int = LIST_BLOCK) -> DataFrame:
    """Edges u, v among nodes (__node, fp) that connect all whose first 64 bits of fp differ in max_bits or fewer: through the
    byte-position index with its count filter and bit check, nodes of equal bits being one entry."""
    head = F.substring("fp", 1, 8)
    entries = materialize(nodes.groupBy(head.alias("head")).agg(F.min("__node").alias("entry")))
    links = fingerprint_links(entries.select(F.col("head").alias("fp")), words=1, max_bits=max_bits, block=block)
    for side in "uv":
        links = links.join(entries.select(F.col("head").alias(side), F.col("entry").alias(f"_{side}")), side)
    same = nodes.select("__node", head.alias("head")).join(entries, "head").where("__node <> entry")
    out = materialize(links.select(F.col("_u").alias("u"), F.col("_v").alias("v")).unionByName(same.select(F.col("__node").alias("u"), F.col("entry").alias("v"))))
    release(entries)
    return out


def deduplicated(df: DataFrame, *, id_col="doc_id", text_col="text", shingle=5, words=8, max_bits=150, block: int = LIST_BLOCK) -> DataFrame:
    """The rows of df without near-duplicates: of each component one row stays, the one with the smallest key.

    Two texts are near-duplicates if their sets of shingles have a Jaccard similarity of SIMILAR (0.8) or
    more, by exact count. Candidates come from the byte-position index, which finds all pairs that differ in four or fewer
    of the first 64 bits, and, as a pair at 0.8 differs in more, from lists that complete it: such a pair shares one (one of BANDS keys of BAND_ROWS least hashes of the set; a
    pair at 0.8 shares none with a chance of 5e-8) and have fingerprints that differ in max_bits or fewer
    (of 512; at 0.8 sets of ten or more differ in 78 on average with a deviation of 8, the worst case of 4 of 5
    in 96 with 9). Rows are judged one by one, whatever their keys repeat: null keys come last within a
    component, ties go by the text's hash. Blank texts are copies of each other."""
    small_batches(df.sparkSession)
    schema = "__key long, __hash long, __row long, __node binary, __fp binary, __keys array<long>"
    # Row numbers must not change between steps: rows are numbered once, with their texts.
    whole = materialize(df.withColumn("__row", F.monotonically_increasing_id()))
    rows = whole.select(F.col(id_col).cast("long").alias("__key"), F.xxhash64(text_col).alias("__hash"), "__row", F.col(text_col).alias("__text"))
    marked = materialize(rows.mapInArrow(_marks(shingle, words), schema))
    first = F.min(F.struct(F.col("__key").isNull().alias("no_key"), "__key", "__hash", "__row")).alias("best")
    nodes = materialize(marked.groupBy("__node").agg(first, F.first("__fp").alias("fp"), F.first("__keys").alias("keys")))

    keys = nodes.select(F.posexplode("keys").alias("band", "key"), "__node")
    shared = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    listed = keys.join(shared, ["band", "key"]).join(nodes.select("__node", "fp"), "__node")
    lists = materialize(listed.select(F.concat(F.hex("band"), F.hex("key")).cast("binary").alias("key"), F.col("__node").alias("fp"), F.col("fp").alias("value")))
    near = materialize(_links(lists, lambda _, fps: _near_bits(_bytes_of(fps), max_bits, 0), block))
    indexed = indexed_candidates(nodes.select("__node", "fp"), block=block)
    parts = connected_components(near.unionByName(indexed))

    # Shingles are compared only within the components of candidates, one text for each set.
    wanted = parts.join(nodes, parts.node == F.col("__node")).select(F.col("component").alias("key"), F.col("node").alias("fp"), F.col("best.__row").alias("__row"))
    texts = whole.select("__row", F.col(text_col).alias("text")).join(wanted, "__row").select("key", "fp", "text")
    sets = materialize(texts.mapInArrow(_sets(shingle), "key binary, fp binary, value binary"))
    links = materialize(_links(sets, lambda _, values: _near_sets([np.frombuffer(v, np.uint64) for v in values]), block))
    parts = connected_components(links)

    best = nodes.join(parts, F.col("__node") == F.col("node"), "left").groupBy(F.coalesce("component", "__node")).agg(F.min("best").alias("best"))
    best = materialize(best.select(F.col("best.__row").alias("__row")))
    gone = materialize(marked.select("__row").join(best, "__row", "left_anti"))
    release(marked, nodes, lists, near, indexed, sets, links, best)
    return whole.join(gone, "__row", "left_anti").select(*df.columns)
