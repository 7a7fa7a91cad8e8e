"""Buckets of packed documents, and a look-up of what a bucket needs in shards of a global table.

Documents are dealt by a hash into buckets of bounded size and travel as compressed packs. A bucket sends each
shard one packed question for the distinct keys it holds, a shard merges the questions, answers each, and the
answers meet the packs of their bucket again. So a key crosses the network once per bucket that holds it, not
once per row, and a key that holds a third of all rows weighs no more than any other.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchframe.llm.common import give_back, partitions

#: Bytes of rows that a task gathers before it packs them by bucket.
PACK_BYTES = 24 << 20


def _stream(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def to_bytes(columns: dict) -> bytes:
    """Columns of one length as compressed Arrow bytes."""
    return _stream(pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns)))


def from_bytes(data: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(data)))


def packed(docs: DataFrame, columns: list[str], text: str, buckets: int | None = None) -> tuple[DataFrame, int]:
    """Packs (bucket int, pack binary) of the given columns, and how many buckets there are.

    Rows are dealt by the hash of all given columns, so that copies of a text under different ids spread.
    """
    n = buckets or partitions(docs)
    rows = docs.select(*[F.col(f"`{c}`") for c in columns])
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(n)).cast("int"))

    def gathered(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= PACK_BYTES:
                yield held
                held, size = [], 0
        yield held

    def pack(batches):
        for held in gathered(batches):
            if not sum(b.num_rows for b in held):
                continue
            table = pa.Table.from_batches(held).sort_by("_bucket").combine_chunks()
            held.clear()
            bucket = table["_bucket"].to_pylist()
            plain = table.drop_columns(["_bucket"])
            buckets, packs, a = [], [], 0
            for b in range(1, len(bucket) + 1):
                if b == len(bucket) or bucket[b] != bucket[a]:
                    buckets.append(bucket[a])
                    packs.append(_stream(plain.slice(a, b - a)))
                    a = b
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(packs, pa.binary())], names=["bucket", "pack"])

    return rows.mapInArrow(pack, "bucket int, pack binary"), n


def unpacked(table: pa.Table):
    """The record batches in the packs of one bucket, one at a time, in an order of their own."""
    for data in sorted(table["pack"].to_pylist()):
        yield from pa.ipc.open_stream(data)
    give_back()
