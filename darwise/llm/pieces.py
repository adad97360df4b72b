"""Texts cut into the pieces that a byte-level vocabulary merges within.

For vocabularies of the tokenizers library that drop white space and write
lower case: words are cut as flat bytes, distinct words once. The library is
asked only for the normalisation of words beyond printable Latin-1 or with what
may be an added token.
"""

import re

import numpy as np
import pyarrow as pa

from darwise.llm.text import SPACE, Slice, flat, worker_cache

PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # the pre-tokenizer that `Words` cuts by
LETTER, DIGIT, OTHER = 1, 2, 3
# Byte-level vocabularies write the bytes of UTF-8 as printable characters.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}



def _latin() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of the code points below 256, by Unicode's general categories."""
    import unicodedata

    kind = [{"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(256)]
    return np.array(kind, np.uint8), np.array([ord(chr(c).lower()) for c in range(256)], np.int64)


def join(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of fixed-width values as a binary array."""
    width = data.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def gather(values: np.ndarray, bounds: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs named by ``index``, one after the other, and their bounds."""
    size = np.diff(bounds)[index]
    out = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(bounds[:-1][index] - out[:-1], size) + np.arange(out[-1])], out


def together(ids: np.ndarray, bounds: np.ndarray, added: list[int], places) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the rows of a slice and their bounds, from the ids of its distinct pieces."""
    piece_of, fixed, pieces_of, word_of, rows = places
    # Added tokens follow as pieces of their own.
    n = len(bounds) - 1
    ids, bounds = np.concatenate([ids, added]).astype(np.uint32), np.concatenate([bounds, bounds[-1] + 1 + np.arange(len(added))])
    ids, by_piece = gather(ids, bounds, np.where(fixed >= 0, n + fixed, piece_of))
    ids, by_word = gather(ids, by_piece[pieces_of], word_of)
    return ids, by_word[rows]


class Words:
    """Cuts words into the pieces a vocabulary merges within."""

    def __init__(self, path: str, added: list[str]):
        self.path, self.added = path, added
        self.kind, self.lower = _latin()

    def distinct_of(self, part: Slice):
        """Bytes and bounds of the distinct pieces of a slice, and ``(piece_of, fixed, pieces_of, word_of, rows)`` to put rows together."""
        starts, ends, rows = part.words()
        if not len(starts):
            return None
        words, word_of = distinct(part.data[~SPACE[part.data]], np.concatenate([[0], np.cumsum(ends - starts)]))
        data, bounds, fixed, pieces_of = self.cut(*words)
        pieces, piece_of = distinct(data, bounds)
        return pieces, (piece_of, fixed, pieces_of, word_of, rows)

    def cut(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes and bounds of all pieces, the number of the added token a piece is (else -1), each word's bounds in pieces."""
        b, n = data, len(data)
        nxt, prev = np.append(b[1:], 0), np.concatenate([[0], b[:-1]])
        lead, tail = (b == 0xC2) | (b == 0xC3), (b & 0xC0) == 0x80
        code = np.where(lead, ((b.astype(np.int64) & 3) << 6) | (nxt & 0x3F), np.where(tail, ((prev.astype(np.int64) & 3) << 6) | (b & 0x3F), b))
        odd = (b < 0x21) | (b == 0x7F) | (b >= 0xC4) | (tail & ((code < 0xA1) | (code == 0xAD))) | ((b == 0x3C) & (nxt == 0x7C))
        # Tails of longer characters follow neither C2 nor C3, but their lead byte is odd, and so is the word.
        slow = np.logical_or.reduceat(odd, off[:-1])
        fast = ~slow
        if slow.any():
            own, (pieces, bounds, fixed, counts) = np.repeat(fast, np.diff(off)), self._odd(data, off, np.flatnonzero(slow))
            b, code, lead, tail = b[own], code[own], lead[own], tail[own]
            size = np.diff(off)[fast]
        else:
            size = np.diff(off)
        at = np.concatenate([[0], np.cumsum(size)])
        low = self.lower[code]
        b = np.where(lead, 0xC0 | (low >> 6), np.where(tail, 0x80 | (low & 0x3F), low)).astype(np.uint8)
        kind, start = self.kind[low], np.zeros(len(b), bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= (kind == DIGIT) & ~tail
        start[at[:-1]] = True
        self._contractions(b, at, start)
        where = np.flatnonzero(start)
        made, made_bounds, by_word = b, np.append(where, len(b)), np.searchsorted(where, at)
        if not slow.any():
            return made, made_bounds, np.full(len(where), -1), by_word
        # Fast words first, then the others: bounds are put in the order of the words.
        data, bounds = np.concatenate([made, pieces]), np.concatenate([made_bounds, made_bounds[-1] + bounds[1:]])
        fixed = np.concatenate([np.full(len(where), -1), fixed])
        count = np.zeros(len(fast), np.int64)
        count[fast], count[slow] = np.diff(by_word), counts
        begin = np.zeros(len(fast), np.int64)
        begin[fast], begin[slow] = by_word[:-1], len(where) + np.concatenate([[0], np.cumsum(counts)])[:-1]
        out = np.concatenate([[0], np.cumsum(count)])
        order = np.repeat(begin - out[:-1], count) + np.arange(out[-1])
        data, bounds = gather(data, bounds, order)
        return data, bounds, fixed[order], out

    @staticmethod
    def _contractions(b: np.ndarray, at: np.ndarray, start: np.ndarray) -> None:
        """'s, 't, 'm, 'd, 're, 've and 'll are pieces where an apostrophe begins a run."""
        marks = np.flatnonzero((b == 0x27) & start)
        if not len(marks):
            return
        end = at[np.searchsorted(at, marks, side="right")]
        one = np.append(b, [0, 0])[marks + 1] * (marks + 1 < end)
        two = np.append(b, [0, 0])[marks + 2] * (marks + 2 < end)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for found, size in ((marks[short], 2), (marks[long], 3)):
            start[found + 1] = False
            after = found + size
            start[after[after < len(b)]] = True

    def _odd(self, data: np.ndarray, off: np.ndarray, which: np.ndarray):
        """Pieces of words beyond printable Latin-1 or with what may be an added token, by the library's normalisation."""
        tokenizer, added = library(self.path), self.added
        bytes_of = {c: b for b, c in BYTE_CHARS.items()}
        split = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        pieces, fixed, counts = [], [], []
        for w in which:
            word = data[off[w] : off[w + 1]].tobytes().decode("utf-8", "replace")
            before = len(pieces)
            for k, part in enumerate(split.split(word) if split else [word]):
                if k % 2:
                    pieces.append(b"\x00")  # stands for the token, and is not merged
                    fixed.append(added.index(part))
                elif part:
                    found = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(part))
                    pieces += [bytes([bytes_of[c] for c in p]) for p, _ in found]
                    fixed += [-1] * len(found)
            counts.append(len(pieces) - before)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        return np.frombuffer(b"".join(pieces), np.uint8), bounds, np.array(fixed, np.int64), np.array(counts, np.int64)


def distinct(data: np.ndarray, bounds: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The distinct runs of bytes with their bounds, and for each run which one it is."""
    found = join(data, bounds).dictionary_encode()
    return flat(found.dictionary), found.indices.to_numpy(zero_copy_only=False)


def library(path: str):
    cache = worker_cache()
    if ("library", path) not in cache:
        from tokenizers import Tokenizer

        cache[("library", path)] = Tokenizer.from_file(path)
    return cache[("library", path)]
