"""Documents packed into blocks that a task can hold, for operators that gather statistics by block.

A block is a few megabytes of documents picked by a hash of their key. Packed blocks move compressed, and as
every step of one plan reads the same exchange of them, texts are shuffled once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block, and bytes a task gathers before it hands packs on.
BLOCK_BYTES, GATHER_BYTES, LEAST_BLOCKS = 12_000_000, 48_000_000, 16


def count_blocks(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks for the texts (column text): enough that each holds block_bytes on average."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BLOCKS, -(-size // block_bytes))


def _pack(rows: dict[int, list[pa.RecordBatch]]) -> pa.RecordBatch:
    payloads = []
    for parts in rows.values():
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(parts).combine_chunks()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        payloads.append(sink.getvalue().to_pybytes())
    return pa.record_batch({"block": pa.array(list(rows), pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[pa.RecordBatch]] = defaultdict(list)
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.take(pc.sort_indices(batch.column(0)))
        keys = batch.column(0).to_numpy()
        cuts = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), len(keys)]
        names = batch.schema.names[1:]
        for a, b in zip(cuts, cuts[1:], strict=False):
            held[int(keys[a])].append(batch.slice(a, b - a).select(names))
        size += batch.nbytes
        if size >= GATHER_BYTES:
            yield _pack(held)
            held, size = defaultdict(list), 0
    if held:
        yield _pack(held)


def pack(df: DataFrame, n: int) -> DataFrame:
    """block, payload from df, whose column block is in [0, n); dealt by block."""
    others = [c for c in df.columns if c != "block"]
    packed = df.select(F.col("block").cast("int").alias("block"), *others).mapInArrow(_packer, "block int, payload binary")
    return packed.repartition(n, "block")


def unpack(table: pa.Table) -> pa.Table:
    """The rows of one block, in the order of their first columns."""
    parts = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in table.column("payload")]
    return pa.concat_tables(parts) if parts else None
