"""Operator 1, suffix-array dedup built blockwise over a difference cover.

Places of a difference cover modulo 31 are the sample: of any two places, some
equal shift below 31 leads to two sampled ones. The sample's suffixes are ranked
first, as far as needed: does a sampled suffix tie with another one over
``window - 30`` bytes? A suffix can only tie over ``window`` bytes if it reaches
a sampled suffix with a tie within its first 31 bytes, so all others are left
out. The remaining suffixes are sorted one group of buckets at a time, which
bounds memory and disk, and the sorted bucket tells for each suffix whether a
document of smaller id holds the same first ``window`` bytes.

Only equality of prefixes matters here, so suffixes are ordered by a 64-bit
hash of their prefix and not by its letters.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from darwise.llm.exchange import ANSWER, Keys, ask, each_block, ids_of, make_blocks, saved, with_answers
from darwise.llm.tables import with_columns
from darwise.llm.text import flat, from_bytes, window_hashes

MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)  # every residue modulo 31 is a difference of two of these
SAMPLE, LIVE, FIRST_ROUND = 0, 1, 2  # levels of the answers
ROUNDS = 4
ADDED = (
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("kept", T.BinaryType()),
)


class Bytes:
    """The bytes of a block, and for each the end of its row."""

    def __init__(self, table: pa.Table):
        self.data, self.off = flat(table["text"])
        lengths = np.diff(self.off)
        self.end = np.repeat(self.off[1:].astype(np.int32), lengths)
        self.row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)


def _sample(text: Bytes, length: int, bucket_bits: int) -> tuple[np.ndarray, Keys]:
    n = len(text.data)
    at = (np.arange(0, n, MODULUS, dtype=np.int64)[:, None] + np.array(COVER)).ravel()
    at = at[at < n]
    at = at[at + length <= text.end[at]]
    return at, Keys(window_hashes(text.data, at, length), bucket_bits, full=False)


def _live(text: Bytes, at: np.ndarray, tied: np.ndarray, window: int) -> np.ndarray:
    """Suffixes with a tied sample among their first bytes."""
    n = len(text.data)
    near = np.zeros(n + 1, np.int32)
    np.add.at(near, np.maximum(at[tied] - (MODULUS - 1), 0), 1)
    np.add.at(near, at[tied] + 1, -1)
    return (np.cumsum(near)[:-1] > 0) & (np.arange(n, dtype=np.int32) + window <= text.end)


def _unpacked(parts: list[dict], n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(parts[0]["bits"], np.uint8), count=n).astype(bool) if parts else np.zeros(n, bool)


def _round_of(h: np.ndarray) -> np.ndarray:
    return ((h & np.uint64(0xFFFF)) % np.uint64(ROUNDS)).astype(np.int8)


def dedup_bytes(docs: DataFrame, window: int = 50) -> DataFrame:
    """Remove bytes of strings that documents of smaller id hold too.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns stay, but for
    those named like an added one: ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs) and ``kept`` (the remaining bytes). A byte goes if
    one of the ``window``-byte strings over it also starts in a document of
    smaller doc_id; strings never cross documents and are judged on the input.
    Null texts are empty; a null doc_id is the smallest; rows of equal doc_id do
    not remove each other's bytes.
    """
    if window < MODULUS + 3:
        raise ValueError(f"windows of {MODULUS + 3} bytes or more")
    spark, short = docs.sparkSession, window - MODULUS + 1
    blocks = make_blocks(docs)
    k = blocks.bucket_bits

    def sample_keys(table, by_level):
        return _sample(Bytes(table), short, k)[1]

    ties = ask(spark, blocks, [], SAMPLE, sample_keys, full=False)

    def mark(batches):
        def rows(block, table, by_level):
            text = Bytes(table)
            at, keys = _sample(text, short, k)
            live = _live(text, at, keys.spread((keys.sizes > 1) | keys.answer(by_level.get(SAMPLE, []))), window)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "level": pa.array([LIVE], pa.int32()), "bucket": pa.array([0], pa.int32()), "n_set": pa.array([int(live.sum())], pa.int64()), "bits": pa.array([np.packbits(live).tobytes()], pa.binary())})

        yield from each_block(rows, batches)

    live = saved(spark, with_answers(blocks, [ties]).mapInArrow(mark, ANSWER), "live")

    def bucket_keys(text, ids, at, h, rounds, r):
        held = rounds == r
        at, h = at[held], h[held]
        own = ids[text.row[at]]
        return at, own, Keys(h, k, full=True, ids=own)

    def suffixes(table, by_level):
        text = Bytes(table)
        at = np.flatnonzero(_unpacked(by_level.get(LIVE, []), len(text.data)))
        h = window_hashes(text.data, at, window)
        return text, ids_of(table), at, h, _round_of(h)

    answers = [live]
    for r in range(ROUNDS):

        def round_keys(table, by_level, r=r):
            return bucket_keys(*suffixes(table, by_level), r)[2]

        answers.append(ask(spark, blocks, [live], FIRST_ROUND + r, round_keys, full=True))
    schema = with_columns(docs.schema, *ADDED)

    def finish(batches):
        def rows(_, table, by_level):
            found = suffixes(table, by_level)
            text = found[0]
            n = len(text.data)
            gone = np.zeros(n + 1, np.int32)
            for r in range(ROUNDS):
                at, own, keys = bucket_keys(*found, r)
                if len(at):
                    hit = at[keys.spread(keys.answer(by_level.get(FIRST_ROUND + r, []))) | (own > keys.spread(keys.least))]
                    gone[hit] += 1  # places are distinct
                    gone[hit + window] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            removed = np.concatenate([[0], np.cumsum(gone)])[text.off]
            begins = gone.copy()
            begins[1:] &= ~gone[:-1] | (text.row[1:] != text.row[:-1])
            spans = np.concatenate([[0], np.cumsum(begins)])[text.off]
            added = {
                "n_bytes": pa.array(np.diff(text.off)), "n_removed": pa.array(np.diff(removed)), "n_spans": pa.array(np.diff(spans)),
                "kept": from_bytes(text.data[~gone], text.off - removed, binary=True),
            }
            columns = [added[f.name] if f.name in added else table[f.name] for f in schema.fields]
            yield from pa.table(columns, names=schema.names).to_batches()

        yield from each_block(rows, batches)

    return with_answers(blocks, answers).mapInArrow(finish, schema)
