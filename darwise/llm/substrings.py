"""Operator 4, substring dedup by level-wise doubling.

Windows of words that are repeated at one length alone are extended to twice
that length. Lengths run 5, 10, 20: a window can only be repeated if both its
halves are. The last round also tells which windows start earlier elsewhere,
and the words those windows cover are removed. Lengths above the window asked
for are not tried: a repeated longer window consists of repeated windows, so it
removes no further word.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from darwise.llm.exchange import Keys, ask, each_block, ids_of, make_blocks, with_answers
from darwise.llm.tables import with_columns
from darwise.llm.text import SLICE_BYTES, from_bytes, joined, run_hashes, sequence_hashes, slices

ADDED = (
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("kept_text", T.StringType()),
)


class Words:
    """All words of a block: hashes, and each row's bounds among them."""

    def __init__(self, texts, keep_places: bool = False):
        hashes, bounds, self.places, total = [], [np.zeros(1, np.int64)], [], 0
        for part in slices(texts, SLICE_BYTES):
            starts, ends, first = part.words()
            hashes.append(run_hashes(part.data, starts, ends))
            bounds.append(first[1:] + total)
            if keep_places:
                self.places.append((part, starts, ends, total))
            total += len(starts)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.bounds = np.concatenate(bounds)
        counts = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.left = np.repeat(self.bounds[1:], counts) - np.arange(total)  # words from here to the row's end


def lengths_up_to(window: int) -> list[int]:
    """Doubling lengths that end at ``window``, the first below 10 (or odd)."""
    out = [window]
    while out[0] % 2 == 0 and out[0] >= 10:
        out.insert(0, out[0] // 2)
    return out


def _candidates(words: Words, lengths: list[int], by_level: dict, upto: int, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that can still be repeated at ``lengths[upto]``, by the answers of the rounds before, and their hashes."""
    hashes = sequence_hashes(words.hashes, lengths[0])
    at = np.flatnonzero(words.left >= lengths[0])
    for level in range(upto):
        keys = Keys(hashes[at], bucket_bits, full=False)
        at = at[keys.spread((keys.sizes > 1) | keys.answer(by_level.get(level, [])))]
        marked = np.zeros(len(words.hashes) + 1, bool)
        marked[at] = True
        at = at[words.left[at] >= lengths[level + 1]]
        at = at[marked[at + lengths[level]]]
        hashes = joined(hashes[: -lengths[level]], hashes[lengths[level] :])
    return at, hashes[at]


def _last_keys(words, table, lengths, by_level, bucket_bits):
    at, hashes = _candidates(words, lengths, by_level, len(lengths) - 1, bucket_bits)
    ids = ids_of(table)[words.row[at]]
    return at, ids, Keys(hashes, bucket_bits, full=True, ids=ids)


def _removed(words: Words, table, lengths, by_level, bucket_bits) -> np.ndarray:
    """Which words go."""
    at, ids, keys = _last_keys(words, table, lengths, by_level, bucket_bits)
    gone = np.zeros(len(words.hashes) + 1, np.int64)
    if len(at):
        later = keys.spread(keys.answer(by_level.get(len(lengths) - 1, []))) | (ids > keys.spread(keys.least))
        row = words.row[at][keys.order]
        same = np.zeros(len(at), bool)
        same[1:] = row[1:] == row[:-1]
        same[keys.heads] = False  # the window before it in the group is another place of the same row
        later[keys.order[same]] = True
        np.add.at(gone, at[later], 1)
        np.add.at(gone, at[later] + lengths[-1], -1)
    return np.cumsum(gone)[:-1] > 0


def _kept_text(words: Words, gone: np.ndarray) -> pa.Array:
    """Kept words of each row, joined by one blank."""
    made = []
    for part, starts, ends, base in words.places:
        keep = ~gone[base : base + len(starts)]
        starts, ends = starts[keep], ends[keep]
        n = len(part.data)
        data = np.append(part.data, np.uint8(32))
        follows = ends < n
        data[ends[follows]] = np.where(np.isin(ends[follows], part.off), data[ends[follows]], 32)
        mask = np.zeros(n + 2, np.int8)
        mask[starts] += 1
        last = np.isin(ends, part.off)  # the byte after the word belongs to the next row
        np.add.at(mask, ends + ~last, -1)
        held = np.cumsum(mask[: n + 1], dtype=np.int8)[:n] > 0
        off = np.concatenate([[0], np.cumsum(held)])[part.off]
        data = data[:n][held]
        # The last kept word of a row may have a blank behind it.
        filled = np.flatnonzero(off[1:] > off[:-1])
        trail = filled[data[off[1:][filled] - 1] == 32]
        data = np.delete(data, off[1:][trail] - 1)
        cut = np.zeros(len(off), np.int64)
        cut[trail + 1] = 1
        made.append(from_bytes(data, off - np.cumsum(cut)))
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


def dedup_substrings(docs: DataFrame, window: int = 20) -> DataFrame:
    """Remove words of repeated windows; adds ``n_words``, ``n_removed`` and ``kept_text``.

    ``docs`` needs ``doc_id`` (long) and ``text``; its other columns stay, but
    for those named like an added one. A word goes if a window of ``window``
    words over it also starts earlier: in a document of smaller doc_id, or
    earlier in the same row. Windows are judged on the input. Null and empty
    texts have no words and an empty ``kept_text``; a null doc_id counts as the
    smallest; rows of equal doc_id do not remove each other's words.
    """
    spark, lengths = docs.sparkSession, lengths_up_to(window)
    blocks = make_blocks(docs)
    k, answers = blocks.bucket_bits, []
    for level in range(len(lengths)):
        last = level == len(lengths) - 1

        def keys_of(table, by_level, level=level, last=last):
            words = Words(table["text"])
            if last:
                return _last_keys(words, table, lengths, by_level, k)[2]
            return Keys(_candidates(words, lengths, by_level, level, k)[1], k, full=False)

        answers.append(ask(spark, blocks, answers, level, keys_of, full=last))
    schema = with_columns(docs.schema, *ADDED)

    def finish(batches):
        def rows(_, table, by_level):
            words = Words(table["text"], keep_places=True)
            gone = _removed(words, table, lengths, by_level, k)
            sums = np.concatenate([[0], np.cumsum(gone)])[words.bounds]
            added = {"n_words": pa.array(np.diff(words.bounds)), "n_removed": pa.array(np.diff(sums)), "kept_text": _kept_text(words, gone)}
            columns = [added[f.name] if f.name in added else table[f.name] for f in schema.fields]
            yield from pa.table(columns, names=schema.names).to_batches()

        yield from each_block(rows, batches)

    return with_answers(blocks, answers).mapInArrow(finish, schema)
