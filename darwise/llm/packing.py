"""Operator 6, best-fit packing planned on the histogram of lengths.

Only lengths are planned: at most ``capacity`` distinct ones, whatever the
number of documents. Best fit runs over counts, longest pieces first; it deals
out ranges of ranks within a length, and a piece finds its place by its rank.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from darwise.llm.exchange import saved
from darwise.llm.tables import partitions, texts
from darwise.llm.tokens import encoded

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """The token ids of each document and its end id, cut only where they are longer than ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        for batch in batches:
            for lo, found in encoded(batch.column("text"), tokenizer):
                own = [f + end for f in found]
                doc = np.repeat(np.arange(len(own)), [-(-len(f) // (4 * capacity)) for f in own])
                piece = np.arange(len(doc)) - np.searchsorted(doc, doc)
                parts = [own[d][4 * capacity * p : 4 * capacity * (p + 1)] for d, p in zip(doc, piece)]
                columns = {
                    "doc_id": batch.column("doc_id").take(pa.array(doc + lo)), "piece": pa.array(piece, pa.int32()), "start": pa.array(piece * capacity, pa.int64()),
                    "length": pa.array([len(p) // 4 for p in parts], pa.int64()), "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(parts, pa.binary())} if with_ids else {}))

    return docs.mapInArrow(cut, PIECE + ", ids binary" * with_ids)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts: rows ``(length, lo, hi, sequence, each, offset)``.

    Piece ``rank`` of a length, ``lo <= rank < hi``, goes to sequence
    ``sequence + (rank - lo) // each`` at ``offset + (rank - lo) % each * length``.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by space left: first sequence, how many
    out, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        done, count = 0, histogram[length]

        def fill(first, bins, space):
            """Put pieces of this length into the bins, each as many as fit."""
            nonlocal done
            each = space // length
            full = min(bins, (count - done) // each)
            if full:
                out.append((length, done, done + full * each, first, each, capacity - space))
                room[space - each * length].append((first, full))
                done += full * each
            if full < bins and done < count:
                left = count - done
                out.append((length, done, count, first + full, left, capacity - space))
                room[space - left * length].append((first + full, 1))
                full, done = full + 1, count
            return first + full, bins - full

        for space in range(length, capacity + 1):
            held, room[space] = room[space], []
            for first, bins in held:
                first, bins = fill(first, bins, space) if done < count else (first, bins)
                if bins:
                    room[space].append((first, bins))
            if done == count:
                break
        if done < count:
            bins = -(-(count - done) // (capacity // length))
            fill(sequences, bins, capacity)
            sequences += bins
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset`` and, if asked, ``ids`` (32-bit little-endian). A document that fits
    is never cut. Null and empty texts are their end id alone; rows of equal
    doc_id are packed one by one; other columns are not looked at.
    """
    spark = docs.sparkSession
    every = saved(spark, pieces(texts(docs, id_col, text_col), tokenizer, end_id, capacity, with_ids), "pieces")
    # A common length is ranked in many parts, whose places come from prefix sums.
    salted = every.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(docs))))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # a row per length
    slots = spark.createDataFrame(plan(histogram, capacity) or [], "length long, _lo long, _hi long, _sequence long, _each long, _offset long")
    before = counts.select("length", "_salt", (F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # The plan has a few rows per length, so its size is bounded by the capacity.
    slots = F.broadcast(slots.withColumnRenamed("length", "_length"))
    placed = ranked.join(slots, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    nth = F.col("_rank") - F.col("_lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_each") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
