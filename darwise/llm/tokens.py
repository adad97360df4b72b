"""Token ids of texts with a public tokenizer, encoded once per distinct piece.

Batches of texts are cut into distinct pieces (``pieces``), and the library
merges each piece that the worker has not seen; the vocabulary merges nothing
across pieces, so the ids of a text are the ids of its pieces in order.
"""

import gc
import os

import numpy as np
import pyarrow as pa

from darwise.llm.pieces import BYTE_CHARS, Words, library, together
from darwise.llm.text import Slice, slices, worker_cache

KEPT_PIECES = 300_000  # pieces a worker remembers before it begins anew; no text is encoded differently for it
BATCH_BYTES = 2 << 20  # of text cut at once; one longer text goes by itself


class Encoder:
    """``encode(texts)`` gives the ids of each text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.merges = self.tokenizer.model.tokenize
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.words, self.added = Words(path, list(added)), list(added.values())
        self.pieces: dict[bytes, bytes] = {}

    def encode_slice(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, one after the other, and the rows' bounds."""
        found = self.words.distinct_of(part)
        if found is None:
            return np.zeros(0, np.uint32), np.zeros(len(part.off), np.int64)
        (data, bounds), places = found
        raw, ends, known = data.tobytes(), bounds.tolist(), self.pieces
        gc.disable()  # many small objects, none in a cycle
        names = [raw[a:b] for a, b in zip(ends, ends[1:])]
        unseen = [n for n in names if n not in known]
        if len(known) + len(unseen) > KEPT_PIECES:
            # Begun anew with what this batch uses.
            known = self.pieces = {n: known[n] for n in names if n in known}
        merges = self.merges
        for name in unseen:
            known[name] = b"".join([t.id.to_bytes(4, "little") for t in merges(name.decode("latin-1").translate(BYTE_CHARS))])
        ids = [known[n] for n in names]
        gc.enable()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return together(np.frombuffer(b"".join(ids), "<u4"), np.concatenate([[0], np.cumsum(size)]), self.added, places)

    def encode(self, texts: list[str | None], many: int = 2000) -> list[bytes]:
        column = pa.array(texts, pa.string())
        return [f for lo in range(0, len(texts), many) for _, found in self.runs(column.slice(lo, many)) for f in found]

    def runs(self, column: pa.Array):
        for part in slices(column, BATCH_BYTES):
            ids, bounds = self.encode_slice(part)
            raw, ends = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
            yield part.lo, [raw[a:b] for a, b in zip(ends, ends[1:])]


def encoder(path: str) -> Encoder:
    """The worker's encoder for this vocabulary file."""
    cache = worker_cache()
    if ("encoder", path) not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        cache[("encoder", path)] = Encoder(path)
    return cache[("encoder", path)]


def encoded(column: pa.Array, path: str):
    """``(first row, list of id bytes)`` for runs of rows of a text column."""
    yield from encoder(path).runs(column)
