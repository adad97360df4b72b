"""Texts as flat byte arrays: words, windows and 64-bit hashes without a loop per row."""

import hashlib
import sys
import types

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19  # texts are worked on in slices of about this size; one longer text is a slice of its own

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True  # word bounds: blank, tab, the line breaks
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z only

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHORT = 64  # bytes of a run that are read eight at a time; longer ones are rare among words
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of a number's first bytes


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for things costly to load."""
    return vars(sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache")))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit hash (the finaliser of a public hash function)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _eights(data: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there on as one number; zeros follow the last byte."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs ``starts:ends`` of bytes: equal runs, equal hashes, wherever they stand.

    Each step of eight bytes mixes what went before, so no pattern of letters
    makes two runs meet, as sums of powers modulo 2**64 do. Runs of over 64
    bytes take a digest.
    """
    eights, size = _eights(data), ends - starts
    h = mix(size.astype(np.uint64) + _STEP)
    live = np.flatnonzero(size <= _SHORT)
    for done in range(0, _SHORT, 8):
        live = live[size[live] > done]
        if not len(live):
            break
        h[live] = mix((h[live] ^ (eights[starts[live] + done] & _FIRST[np.minimum(size[live] - done, 8)])) + _STEP)
    held = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size > _SHORT):
        h[i] = int.from_bytes(hashlib.blake2b(held[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def window_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` bytes (8 or more) from each of ``at`` on."""
    eights, h = _eights(data), np.full(len(at), _STEP)
    for done in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        h = mix((h ^ eights[at + done]) + _STEP)
    return h


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of two neighbours from their own."""
    return mix(left * _STEP + right)


def sequence_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` values from each place on that has as many, by doubling."""
    if length == 1:
        return values
    if length > len(values):
        return np.zeros(0, np.uint64)
    if length % 2:
        return joined(sequence_hashes(values, length - 1)[:-1], values[length - 1 :])
    half = sequence_hashes(values, length // 2)
    return joined(half[: -(length // 2)], half[length // 2 :])


class Slice:
    """Rows ``lo:hi`` of a batch: their bytes, and ``off`` with the bounds of each row's bytes."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, off: np.ndarray):
        self.lo, self.hi, self.data, self.off = lo, hi, data, off

    def words(self, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and for each row the number of its first word (one more at the end)."""
        gap = space[self.data]
        first, last = np.empty(len(gap), bool), np.empty(len(gap), bool)
        first[1:], last[:-1] = gap[:-1], gap[1:]
        filled = self.off[:-1] < self.off[1:]
        first[self.off[:-1][filled]] = True
        last[self.off[1:][filled] - 1] = True
        starts, ends = np.flatnonzero(~gap & first), np.flatnonzero(~gap & last) + 1
        return starts, ends, np.searchsorted(starts, self.off)


def filled(batches):
    """The batches that have rows; what Arrow holds free after them goes back."""
    yield from (b for b in batches if b.num_rows)
    pa.default_memory_pool().release_unused()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a text or binary array; nulls are empty. No copy unless there are nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, size: int = SLICE_BYTES):
    """The rows of an array of texts as slices of about ``size`` bytes, at least one row each."""
    data, off = flat(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """For each item the row it belongs to, from the rows' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def from_bytes(data: np.ndarray, off: np.ndarray, binary: bool = False) -> pa.Array:
    """An Arrow text or binary array over flat bytes."""
    kind = pa.large_binary() if binary else pa.large_string()
    made = pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return made.cast(pa.binary() if binary else pa.string())
