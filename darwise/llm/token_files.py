"""Operator 9, token ids as flat binary files.

Documents are range-partitioned and sorted by doc_id. Each task writes its part
as three files: ``.ids`` (unsigned 16-bit if the vocabulary fits, else 32-bit,
little-endian), ``.off`` (64-bit starts within the part, one more than
documents) and ``.doc`` (64-bit doc_ids; a null is the smallest long). The
places of parts in the whole come from prefix sums of their sizes, one row per
part, kept in the manifest. Readers map the files into memory.
"""

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from darwise.llm.files import mapped, place, put, qualified
from darwise.llm.tables import partitions, texts
from darwise.llm.tokens import encoded, encoder

NO_ID = -(2**63)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode every text, append ``end_id`` and write the files; returns the manifest.

    Null texts are empty (their end id alone); rows of equal doc_id stand in the
    order of their texts; other columns are not looked at. ``tokenizer`` is the
    path of a vocabulary file of the tokenizers library.
    """
    n, folder = partitions(docs), qualified(docs.sparkSession, folder)
    ordered = texts(docs, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        part = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        vocabulary = max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1)
        width = 2 if vocabulary <= 1 << 16 else 4
        end, ids, sizes = np.array([end_id], f"<u{width}").tobytes(), [], []

        def stream(out):
            for batch in _chain(first, batches):
                ids.append(batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
                for _, found in encoded(batch.column("text"), tokenizer):
                    counts = np.array([len(f) // 4 for f in found], np.int64)
                    sizes.append(counts + 1)
                    for f in found:
                        out.write(np.frombuffer(f, "<u4").astype(f"<u{width}").tobytes() + end)

        path = f"{folder}/part-{part:06d}"
        put(f"{path}.ids", stream)
        counts = np.concatenate(sizes)
        put(f"{path}.off", lambda out: out.write(np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes()))
        put(f"{path}.doc", lambda out: out.write(np.concatenate(ids).astype("<i8").tobytes()))
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(counts)], "tokens": [int(counts.sum())], "width": [width]})

    # One row per part comes back.
    rows = sorted(ordered.mapInArrow(write, "part long, docs long, tokens long, width long").collect())
    parts, doc, token = [], 0, 0
    for r in rows:
        parts.append({"part": r.part, "docs": r.docs, "tokens": r.tokens, "first_doc": doc, "first_token": token})
        doc, token = doc + r.docs, token + r.tokens
    manifest = {"width": rows[0].width if rows else 2, "end_id": end_id, "docs": doc, "tokens": token, "parts": parts}
    put(f"{folder}/manifest.json", lambda out: out.write(json.dumps(manifest).encode()))
    return manifest


def _chain(first, rest):
    yield first
    yield from rest


def read_manifest(folder: str) -> dict:
    system, at = place(f"{folder}/manifest.json")
    with system.open_input_stream(at) as source:
        return json.loads(source.read())


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """The files as ``doc_id, start, n_tokens, ids_crc32`` (of the ids as 32-bit), with ``ids`` (32-bit bytes) if asked."""
    folder = qualified(spark, folder)
    manifest = read_manifest(folder)
    width, schema = manifest["width"], "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    rows = [(p["part"], p["first_token"]) for p in manifest["parts"]]
    parts = spark.createDataFrame(rows, "part long, first_token long").repartition(max(1, len(rows)))

    def read(batches):
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("first_token").to_pylist()):
                path = f"{folder}/part-{part:06d}"
                ids = np.frombuffer(mapped(f"{path}.ids"), f"<u{width}")
                off, doc = np.frombuffer(mapped(f"{path}.off"), "<i8"), np.frombuffer(mapped(f"{path}.doc"), "<i8")
                for lo in range(0, len(doc), 1000):
                    own = off[lo : lo + 1001]
                    found = [ids[a:b].astype("<u4").tobytes() for a, b in zip(own[:-1], own[1:])]
                    held = doc[lo : lo + 1000]
                    columns = {"doc_id": pa.array(held, pa.int64(), mask=held == NO_ID), "start": pa.array(own[:-1] + base), "n_tokens": pa.array(np.diff(own)), "ids_crc32": pa.array([zlib.crc32(f) for f in found], pa.int64())}
                    yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(found, pa.binary())} if with_ids else {}))

    return parts.mapInArrow(read, schema)
