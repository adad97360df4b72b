"""Operator 10, SimHash near-duplicates over an inverted index of byte positions.

Fingerprints with at most 3 differing bits share at least 5 of their 8 bytes, in
place. The index lists fingerprints under shared positional bytes; a pair's
shared bytes are tallied, pairs below 5 are dropped and the rest verified bit by
bit. Lists of a single byte would hold a 256th of all fingerprints, so lists go
by four positional bytes at once: the 14 blocks of the Steiner system S(3, 4, 8)
are such that whichever 3 bytes differ, some block avoids them. Equal
fingerprints are one entry however many documents have them, and a list gives a
spanning set of its links, not all pairs; a very long list is dealt out again by
a fifth shared byte.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from darwise.llm.components import connected
from darwise.llm.exchange import saved
from darwise.llm.tables import with_columns
from darwise.llm.text import LOWER, SPACE, filled, slices

SHINGLE, SEED, BITS = 3, 42, 3
LONG_LIST = 50_000  # fingerprints in one list before it is split by a further byte
# Affine planes of the 3-dimensional space over two elements, as sets of the 8 positions.
BLOCKS = [tuple(p for p in range(8) if bin(p & a).count("1") % 2 == c) for a in range(1, 8) for c in (0, 1)]


def fingerprints(part) -> np.ndarray:
    """The 64-bit fingerprints of a slice of texts."""
    data = LOWER[part.data]
    starts, ends, first = part.words(SPACE)
    rows = len(part.off) - 1
    # All words joined by one blank: a shingle is a piece of this.
    at = np.cumsum(np.concatenate([[0], ends - starts + 1]))
    keep = ~SPACE[data]
    joined = np.full(int(at[-1]), 32, np.uint8)
    place = np.ones(int(at[-1]), bool)
    place[at[1:] - 1] = False
    joined[place] = data[keep]
    counts = np.diff(first)
    shingles = np.where(counts == 0, 0, np.maximum(counts - SHINGLE + 1, 1))
    row = np.repeat(np.arange(rows), shingles)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    begin = first[:-1][row] + nth
    end = np.minimum(begin + SHINGLE, first[1:][row]) - 1
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(text[a:b], SEED) for a, b in zip(at[begin].tolist(), (at[end] + (ends - starts)[end]).tolist())], np.uint64)
    out = np.zeros(rows, np.uint64)
    held = np.flatnonzero(shingles)
    if len(held):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        begins = np.cumsum(shingles)[held] - shingles[held]
        ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
        out[held] = np.packbits(2 * ones > shingles[held][:, None], axis=1).view(">u8").ravel()
    return out


def with_fingerprints(docs: DataFrame, name: str = "_fp") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a long, its bits read as signed."""
    schema = with_columns(docs.schema, T.StructField(name, T.LongType()))

    def run(batches):
        for batch in filled(batches):
            found = [fingerprints(part) for part in slices(batch.column("text"))]
            made = pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([made if f.name == name else batch.column(f.name) for f in schema.fields], names=schema.names)

    return docs.mapInArrow(run, schema)


def _entries(batches):
    """Each fingerprint under its 14 lists: the block's number and the four bytes."""
    for batch in filled(batches):
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        of = fp.view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        for number, block in enumerate(BLOCKS):
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(fp), number, np.int32)), "bytes": pa.array(np.ascontiguousarray(of[:, block]).view(">u4").ravel().astype(np.int64)), "fp": pa.array(fp)})


def _fifth(batches):
    """Entries of long lists once under each further byte: at least one of the other four is shared too."""
    for batch in filled(batches):
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        number = batch.column("block").to_numpy(zero_copy_only=False)
        of = fp.view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        others = np.array([[p for p in range(8) if p not in b] for b in BLOCKS])[number]
        for j in range(4):
            more = of[np.arange(len(fp)), others[:, j]].astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(batch.column("bytes").to_numpy(zero_copy_only=False) + ((1 + j) << 48) + (more << 40)), batch.column("fp")], names=["block", "bytes", "fp"])


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the 8 bytes of each XOR are zero."""
    y = x | (x >> np.uint64(4))
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    return 8 - np.bitwise_count(y & np.uint64(0x0101010101010101))


def spanning(fps: np.ndarray, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one list, each a verified pair.

    Breadth first: what has been reached is compared with what has not, so each
    fingerprint is reached by one link, however close the whole list is.
    """
    unseen, left, right = np.arange(len(fps)), [], []
    while len(unseen):
        frontier, unseen = unseen[:1], unseen[1:]
        while len(frontier) and len(unseen):
            step = max(1, cells // len(unseen))
            own, frontier = frontier[:step], frontier[step:]
            x = fps[own][:, None] ^ fps[unseen][None, :]
            near = (shared_bytes(x) >= 8 - BITS) & (np.bitwise_count(x) <= BITS)
            hit = near.any(0)
            left.append(own[near[:, hit].argmax(0)])
            right.append(unseen[hit])
            frontier, unseen = np.concatenate([frontier, unseen[hit]]), unseen[~hit]
    if not left:
        return fps[:0], fps[:0]
    return fps[np.concatenate(left)], fps[np.concatenate(right)]


def _links(batches):
    for batch in filled(batches):
        a, b = [], []
        for fps in batch.column("fps"):
            x, y = spanning(np.array(fps.values.to_numpy(zero_copy_only=False)).view(np.uint64))
            a.append(x)
            b.append(y)
        if a:
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a).view(np.int64)), "b": pa.array(np.concatenate(b).view(np.int64))})


def links(distinct: DataFrame) -> DataFrame:
    """Verified pairs of distinct fingerprints (``fp``) that span all their components."""
    spark = distinct.sparkSession
    entries = distinct.mapInArrow(_entries, "block int, bytes long, fp long")
    sizes = saved(spark, entries.groupBy("block", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
    kept = entries.join(sizes, ["block", "bytes"])
    short = kept.where(F.col("n") <= LONG_LIST).select("block", "bytes", "fp")
    split = kept.where(F.col("n") > LONG_LIST).select("block", "bytes", "fp").mapInArrow(_fifth, "block int, bytes long, fp long")
    lists = short.unionByName(split).groupBy("block", "bytes").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return lists.select("fps").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, root: str | None = None) -> DataFrame:
    """Add ``fingerprint`` (16 hex digits) and ``component_id`` to ``docs`` (``doc_id``, ``text``, more).

    Words are lower-cased in A-Z, shingles are 3 words; texts of fewer words are
    one shingle, texts without words (null too) have fingerprint zero and are
    linked like any other. ``component_id`` is the smallest doc_id that can be
    reached over links of at most 3 differing bits (null ids are passed over,
    unless there is no other). ``root`` names a column for a number that each group has for
    itself, as groups share a component_id where doc_ids are repeated. Input columns named like an
    added one give way.
    """
    spark = docs.sparkSession
    bare = docs.drop("text")
    printed = saved(spark, with_fingerprints(docs).select(*bare.columns, "_fp"), "fingerprints")
    least = saved(spark, printed.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected(links(least.select("fp")))
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(of_root, "root").select(F.col("fp").alias("_fp"), "component_id", *([F.col("root").alias(root)] if root else []))
    out = printed.drop("component_id", "fingerprint").join(by_print, "_fp", "left")
    return out.withColumn("fingerprint", F.lpad(F.lower(F.hex("_fp")), 16, "0")).drop("_fp")
