"""Who else has this key? Asked by blocks of documents, answered by buckets of keys.

Documents are written once as blocks (a few MB of compressed text, one row
each, bucketed by block number). In a round every block sends its distinct keys
to the bucket their leading bits name; the bucket finds which keys other blocks
have too and sends back one bit per key. Text is never shuffled, keys of one
block are sent once however often they occur, and a hot key costs one entry per
block. Joins of answers with blocks move only the answers.
"""

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from darwise.llm.tables import partitions
from darwise.llm.text import filled, flat
from darwise.sources.scratch import scratch_path, short_lived_shuffles

BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20  # of text for each bucket
FILTER_BITS = 32  # bits of a key that a filter round sends, besides the bucket's
NO_ID = -(2**63)  # stands for a null doc_id, which sorts first
ANSWER = "block long, level int, bucket int, n_set long, bits binary"


class Blocks:
    """The stored blocks: the frame, the schema of the documents in them, and how keys are dealt."""

    def __init__(self, frame: DataFrame, schema: T.StructType, bucket_bits: int):
        self.frame, self.schema, self.bucket_bits = frame, schema, bucket_bits


def _sealed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def make_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Write the documents (``doc_id``, ``text``, more) as blocks in the shared folder.

    Documents within a block stand in ascending doc_id. A text longer than
    ``block_bytes`` is a block of its own.
    """

    def pack(batches):
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            nonlocal made, held, size
            table = pa.Table.from_batches(held)
            ids = table["doc_id"].fill_null(NO_ID).combine_chunks()
            table = table.take(pa.array(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")))
            row = pa.RecordBatch.from_pydict({"block": pa.array([(task << 32) | made], pa.int64()), "raw": pa.array([size], pa.int64()), "data": pa.array([_sealed(table)], pa.binary())})
            made, held, size = made + 1, [], 0
            return row

        for batch in batches:
            _, off = flat(batch.column("text"))
            lo = 0
            while lo < batch.num_rows:
                room = max(block_bytes - size, 0)
                hi = max(lo + (not held), int(np.searchsorted(off, off[lo] + room, side="right")) - 1)
                hi = min(hi, batch.num_rows)
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
                    size += int(off[hi] - off[lo])
                if hi < batch.num_rows:
                    yield block()
                lo = hi
        if held:
            yield block()

    spark = docs.sparkSession
    n, path, name = partitions(docs), scratch_path(spark, "blocks"), f"blocks_{uuid.uuid4().hex}"
    frame = docs.mapInArrow(pack, "block long, raw long, data binary")
    # The data are compressed already.
    frame.write.bucketBy(n, "block").option("compression", "none").option("path", path).saveAsTable(name)
    frame = spark.table(name)  # keeps its place and buckets when the name goes
    spark.sql(f"DROP TABLE {name}")
    raw = frame.agg(F.sum("raw")).first()[0] or 0
    bits = max(math.ceil(math.log2(max(1, raw / BUCKET_BYTES))), math.ceil(math.log2(n)), 1)
    return Blocks(frame, docs.schema, bits)


def _order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable sorting order of keys of so many bits, and the sorted keys."""
    n = max(1, len(key).bit_length())
    if bits + n <= 64:  # key and place in one number: sorted without an index array
        packed = np.sort((key << np.uint64(n)) | np.arange(len(key), dtype=np.uint64))
        return (packed & np.uint64((1 << n) - 1)).astype(np.int64), packed >> np.uint64(n)
    order = np.argsort(key, kind="stable")
    return order, key[order]


class Keys:
    """The keys of one block in a round, grouped: what is sent, and how an answer is read."""

    def __init__(self, h: np.ndarray, bucket_bits: int, full: bool, ids: np.ndarray | None = None):
        self.full, self.bits = full, 64 if full else bucket_bits + FILTER_BITS
        self.shift = np.uint64(self.bits - bucket_bits)
        self.order, ordered = _order(h if full else h >> np.uint64(64 - self.bits), self.bits)
        self.heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), ordered[1:] != ordered[:-1]]))
        self.sizes = np.diff(np.append(self.heads, len(h)))
        self.unique = ordered[self.heads]
        self.least = np.minimum.reduceat(ids[self.order], self.heads) if ids is not None and len(h) else ids

    def rows(self, block: int):
        bucket = (self.unique >> self.shift).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1]]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(bucket))):
            keys = self.unique[lo:hi]
            sent = keys.tobytes() if self.full else (keys & np.uint64(2**FILTER_BITS - 1)).astype(np.uint32).tobytes()
            yield int(bucket[lo]), block, sent, self.least[lo:hi].tobytes() if self.least is not None else b""

    def answer(self, parts: list[dict]) -> np.ndarray:
        """One boolean per distinct key, in their order."""
        if not len(self.unique):
            return np.zeros(0, bool)
        parts = sorted(parts, key=lambda p: p["bucket"])
        counts = np.bincount((self.unique >> self.shift).astype(np.int64))
        return np.concatenate([np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=int(counts[p["bucket"]])) for p in parts]).astype(bool)

    def spread(self, of_key: np.ndarray) -> np.ndarray:
        """What holds for a key, for each of its places."""
        out = np.empty(len(self.order), of_key.dtype)
        out[self.order] = np.repeat(of_key, self.sizes)
        return out


def ids_of(table: pa.Table) -> np.ndarray:
    return table["doc_id"].fill_null(NO_ID).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def with_answers(blocks: Blocks, answers: list[DataFrame]) -> DataFrame:
    """Each block with all its answers so far."""
    if not answers:
        return blocks.frame.select("block", "data", F.expr("cast(null as array<struct<level int, bucket int, bits binary>>)").alias("answers"))
    union = answers[0]
    for more in answers[1:]:
        union = union.unionByName(more)
    by_block = union.groupBy("block").agg(F.collect_list(F.struct("level", "bucket", "bits")).alias("answers"))
    # A merge join keeps the blocks where their buckets are.
    return blocks.frame.select("block", "data").join(by_block.hint("merge"), "block", "left")


def each_block(fn: Callable, batches):
    """``fn(block, table, answers by level)`` for each row of ``with_answers``; yields what it yields."""
    for batch in filled(batches):
        for i in range(batch.num_rows):
            by_level: dict[int, list] = {}
            for part in batch.column("answers")[i].as_py() or []:
                by_level.setdefault(part["level"], []).append(part)
            yield from fn(batch.column("block")[i].as_py(), opened(batch.column("data")[i].as_buffer()), by_level)


def _repeated(sent: list[bytes], _ids):
    every = [np.frombuffer(s, np.uint32) for s in sent]
    ordered = np.sort(np.concatenate(every))
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    for own in every:
        at = np.searchsorted(shared, own)
        at[at == len(shared)] = 0
        yield shared[at] == own if len(shared) else np.zeros(len(own), bool)


def _earlier(sent: list[bytes], ids: list[bytes]):
    lengths = [len(s) // 8 for s in sent]
    keys, who = np.frombuffer(b"".join(sent), np.uint64), np.frombuffer(b"".join(ids), np.int64)
    order = np.argsort(keys)
    ordered = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    least = np.repeat(np.minimum.reduceat(who[order], heads), np.diff(np.append(heads, len(keys))))
    found = np.empty(len(keys), bool)
    found[order] = least < who[order]
    at = 0
    for n in lengths:
        yield found[at : at + n]
        at += n


def ask(spark: SparkSession, blocks: Blocks, answers: list[DataFrame], level: int, keys_of: Callable, full: bool) -> DataFrame:
    """One round. ``keys_of(table, answers by level)`` gives the ``Keys`` of a block.

    A filter round (``full`` false) answers whether another block has the key
    too; a full round whether a document of smaller id in another block has it.
    """

    def send(batches):
        def rows(block, table, by_level):
            sent = list(keys_of(table, by_level).rows(block))
            if sent:
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([s[0] for s in sent], pa.int32()), "block": pa.array([s[1] for s in sent], pa.int64()), "sent": pa.array([s[2] for s in sent], pa.binary()), "ids": pa.array([s[3] for s in sent], pa.binary())})

        yield from each_block(rows, batches)

    find = _earlier if full else _repeated

    def reply(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        found = list(find(table["sent"].to_pylist(), table["ids"].to_pylist()))
        return pa.table(
            {
                "block": table["block"], "level": pa.array([level] * len(found), pa.int32()), "bucket": pa.array([bucket] * len(found), pa.int32()),
                "n_set": pa.array([int(f.sum()) for f in found], pa.int64()), "bits": pa.array([np.packbits(f).tobytes() for f in found], pa.binary()),
            }
        )

    sent = with_answers(blocks, answers).mapInArrow(send, "bucket int, block long, sent binary, ids binary")
    return saved(spark, sent.groupBy("bucket").applyInArrow(reply, ANSWER), "answers")


def saved(spark: SparkSession, df: DataFrame, kind: str) -> DataFrame:
    path = scratch_path(spark, kind)
    with short_lived_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
