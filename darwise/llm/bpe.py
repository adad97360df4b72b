"""Operator 13, byte-pair encoding and decoding in batched numpy merge rounds.

A batch of texts is cut into words, its distinct words into pieces, and the
bytes of all distinct pieces stand as symbols in one flat array. In a round
every piece merges its pair of lowest rank; ranks are found by binary search
over the sorted keys of all pairs. Pieces without a pair left leave the array,
so late rounds are short. Decoding is one gather of token texts by id.

Vocabularies are files of the tokenizers library for byte-level BPE with a mark
on the last symbol of a piece, in which white space is dropped. The library is
asked only for the normalisation of parts beyond printable Latin-1.
"""

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from darwise.llm.pieces import BYTE_CHARS, PIECES, Words, gather, join, together
from darwise.llm.tables import with_columns
from darwise.llm.text import Slice, filled, slices, worker_cache

BATCH_BYTES = 4 << 20  # of text whose distinct words are merged together; one longer text goes by itself
NONE = np.int32(2**31 - 1)  # rank of a pair that never merges
IDS, DECODED = T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())


class Vocabulary:
    """A vocabulary file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            held = json.load(source)
        model, pre = held["model"], (held["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or held["decoder"] or pre[0].get("pattern", {}).get("Regex") != PIECES:
            raise ValueError("not a byte-level BPE vocabulary with word ends whose white space is dropped")
        self.path, ids = path, model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(ids.values()) + 1
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys, self.ranks = (left * self.size + right)[order], order.astype(np.int32)
        if self.size <= 1 << 16:
            self.keys = self.keys.astype(np.uint32)
        self.result = np.array([ids[a + b] for a, b in pairs], np.int32)
        # A merge whose product may take part in an earlier merge is done one at a time.
        least = np.full(self.size, len(pairs), np.int64)
        np.minimum.at(least, left, np.arange(len(pairs)))
        np.minimum.at(least, right, np.arange(len(pairs)))
        self.alone = least[self.result] < np.arange(len(pairs))
        suffix = model["end_of_word_suffix"]
        self.byte = np.array([[ids[BYTE_CHARS[b]] for b in range(256)], [ids[BYTE_CHARS[b] + suffix] for b in range(256)]], np.int32)
        added = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.added, self.words = added, Words(path, list(added))
        names = {i: s for s, i in (ids | added).items()}
        shown = [(names.get(i, "") + " ").encode() if i in names else b"" for i in range(max(names) + 1)]
        self.token_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.token_bounds = np.concatenate([[0], np.cumsum([len(s) for s in shown])])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NONE`` for those that never merge."""
        asked = (left.astype(self.keys.dtype) * self.keys.dtype.type(self.size)) + right.astype(self.keys.dtype)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, self.ranks[at], NONE)

    def merged(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the symbols of each piece merge to, with the pieces' new bounds. No piece is empty."""
        n = len(symbols)
        final, alive = symbols.copy(), np.zeros(n, bool)
        piece = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        s, place = symbols, np.arange(n, dtype=np.int64)
        r = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(piece[:-1] == piece[1:]) if n else np.zeros(0, np.int64)
        r[inner] = self.rank(s[inner], s[inner + 1])
        while len(s):
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            size = np.diff(np.append(first, len(s)))
            least = np.minimum.reduceat(r, first)
            over = least == NONE
            if over.any():
                out = np.repeat(over, size)
                final[place[out]], alive[place[out]] = s[out], True
                s, place, piece, r = s[~out], place[~out], piece[~out], r[~out]
                least, size = least[~over], size[~over]
                if not len(s):
                    break
            at = np.flatnonzero(r == np.repeat(least, size))
            # Of overlapping pairs (a a a) every second one, from the left.
            start = np.concatenate([[True], np.diff(at) != 1])
            run = np.flatnonzero(start)[np.cumsum(start) - 1]
            keep = (np.arange(len(at)) - run) % 2 == 0
            if self.alone[r[at]].any():
                keep &= ~self.alone[r[at]] | np.concatenate([[True], piece[at[1:]] != piece[at[:-1]]])
            at = at[keep]
            s = s.copy()
            s[at] = self.result[r[at]]
            left = np.ones(len(s), bool)
            left[at + 1] = False
            s, place, piece, r = s[left], place[left], piece[left], r[left]
            at = at - np.arange(len(at))
            r[at] = NONE
            before = at[(at > 0)] - 1
            again = np.concatenate([at[at + 1 < len(s)], before])
            same = piece[again] == piece[again + 1]
            r[again[~same]] = NONE
            again = again[same]
            r[again] = self.rank(s[again], s[again + 1])
        return final[alive], np.concatenate([[0], np.cumsum(alive)])[bounds]

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, one after the other, and the rows' bounds."""
        found = self.words.distinct_of(part)
        if found is None:
            return np.zeros(0, np.uint32), np.zeros(len(part.off), np.int64)
        (data, bounds), places = found
        symbols = self.byte[0][data]
        symbols[bounds[1:] - 1] = self.byte[1][data[bounds[1:] - 1]]
        return together(*self.merged(symbols, bounds), list(self.added.values()), places)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token texts joined by one blank: bytes of all rows and their bounds. Ids without a token have no text."""
        known = ids < len(self.token_bounds) - 1
        if not known.all():
            ids, bounds = ids[known], np.concatenate([[0], np.cumsum(known)])[bounds]
        data, by_token = gather(self.token_bytes, self.token_bounds, ids)
        out = by_token[bounds]
        # The blank after a row's last token goes.
        some = np.diff(out) > 0
        keep = np.ones(len(data), bool)
        keep[out[1:][some] - 1] = False
        return data[keep], out - np.concatenate([[0], np.cumsum(some)])


def vocabulary(path: str) -> Vocabulary:
    """The worker's arrays of a vocabulary file."""
    cache = worker_cache()
    if ("bpe", path) not in cache:
        cache[("bpe", path)] = Vocabulary(path)
    return cache[("bpe", path)]


def _binary(data: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return join(data, bounds).cast(pa.binary()).cast(kind) if kind == pa.string() else join(data, bounds).cast(kind)


def _with(df: DataFrame, added: T.StructField, make, source: str) -> DataFrame:
    """``df`` with a column made from ``source``, a few MB of it at a time."""
    schema = with_columns(df.schema, added)

    def run(batches):
        for batch in filled(batches):
            for part in slices(batch.column(source), BATCH_BYTES):
                rows = batch.slice(part.lo, part.hi - part.lo)
                made = make(part)
                yield pa.RecordBatch.from_arrays([made if f.name == added.name else rows.column(f.name) for f in schema.fields], names=schema.names)

    return df.mapInArrow(run, schema)


def encode_texts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``: each text's token ids as little-endian unsigned 32-bit bytes.

    Ids are those of the tokenizers library without special tokens around the
    text. Null and empty texts have none; nothing but the text is looked at, so
    repeated rows and null ids stay as they are; a column ``ids`` gives way.
    No row is shuffled, and a text of any length is encoded whole.
    """

    def make(part):
        ids, bounds = vocabulary(path).encode(part)
        return _binary(ids.astype("<u4"), bounds, pa.binary())

    return _with(docs, IDS, make, text_col)


def decode_ids(df: DataFrame, path: str) -> DataFrame:
    """``df`` with ``decoded``: the texts of the tokens of ``ids``, joined as the library's ``decode`` does for this vocabulary.

    Special tokens are written out; null and empty ``ids`` give an empty text;
    ids without a token are left out; a column ``decoded`` gives way.
    """

    def make(part):
        ids = np.frombuffer(part.data.tobytes(), "<u4")
        return _binary(*vocabulary(path).decode(ids, part.off // 4), pa.string())

    return _with(df, DECODED, make, "ids")
