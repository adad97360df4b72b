"""Operator 7, an interpolated modified Kneser-Ney model of n-grams of words.

Counting runs in Spark. Words are counted first; a word's number is its place in
their sorted hashes. Tasks then count the n-grams of their texts and send them
to the bucket their hash names, a group of buckets per round so that disk stays
bounded; a bucket adds up and writes its n-grams as sorted hash arrays. The
hash of an n-gram and what of its words does not fit into 64 bits (a few bits of
the third word, and the later ones) give back all its words, so what the n-grams
one word shorter need (the number of different words before them, and the counts
of what follows them) is read from those files, again in rounds.
A frequent word or n-gram is one entry per bucket there, so no key gathers many
rows. Workers map the arrays into memory and look up the sorted keys of a slice
of text at a time.
"""

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from darwise.llm.exchange import saved
from darwise.llm.files import mapped, put, qualified, removed
from darwise.llm.tables import with_columns
from darwise.llm.text import LOWER, filled, mix, run_hashes, slices, worker_cache
from darwise.sources.scratch import scratch_path

ORDER = 3
ROUNDS = 4
BUCKET_BYTES = 8 << 20  # of text for each bucket
LEAST_BITS = 5  # of a hash that name its bucket: enough buckets for small corpora to keep some cores busy
FLUSH_TOKENS = 1 << 20  # tokens counted together before they are sent
SCORED_BYTES = 2 << 20  # of text whose keys are looked up together
MAPPED = 20_000  # files that a worker holds mapped at once; systems allow some 65,000
READERS = 10_000  # tasks that read stored n-grams, at most
END = np.uint64(0x14057B7EF767814F)  # stands for a text's end among the hashes of words
START, UNKNOWN = np.uint32(0), np.uint32(0xFFFFFFFF)  # among the numbers of words: before a text, and not in training
STEP = 0x9E3779B97F4A7C15
ADDED = (
    T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
    T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
)
MANY = 255  # numbers from here on stand in a list of their own


def tokens(part) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a slice (words in lower case, then the end), and each row's bounds."""
    part.data = LOWER[part.data]
    starts, ends, first = part.words()
    bounds = first + np.arange(len(first))
    own = np.empty(int(bounds[-1]), np.uint64)
    word = np.ones(len(own), bool)
    word[bounds[1:] - 1] = False
    own[word] = run_hashes(part.data, starts, ends)
    own[~word] = END
    return own, bounds


def shifted(values: np.ndarray, bounds: np.ndarray, first) -> np.ndarray:
    """What stands one place before, ``first`` at the start of a row."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[bounds[:-1]] = first
    return out


def ngrams(own: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """A column for each place, the n-gram that ends there from top to bottom."""
    rows = [own]
    for _ in range(order - 1):
        rows.append(shifted(rows[-1], bounds, START))
    return np.stack(rows[::-1])


def gram_key(words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams of numbered words. Up to two words nothing is lost; each later one goes in with the hash before it."""
    wide = words[:2].astype(np.uint64)
    key = mix(wide[0] if len(wide) == 1 else (wide[0] << np.uint64(32)) | wide[1])
    for own in words[2:]:
        key = mix(key * np.uint64(STEP) + own)
    return key


def _unmix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    for odd in (0xC4CEB9FE1A85EC53, 0xFF51AFD7ED558CCD):  # the factors of mix, last first
        h = h * np.uint64(pow(odd, -1, 1 << 64))
        h ^= h >> np.uint64(33)
    return h


def context_key(key: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hashes of the first words of n-grams of three or more from the n-grams' and their last words."""
    return (_unmix(key) - last.astype(np.uint64)) * np.uint64(pow(STEP, -1, 1 << 64))


def words_of(key: np.ndarray, tails: np.ndarray, level: int) -> np.ndarray:
    """The words of n-grams from their hashes and their third and later words: ``gram_key`` backwards."""
    for own in tails[::-1]:
        key = context_key(key, own)
    key = _unmix(key)
    first = [key] if level == 1 else [key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)]
    return np.concatenate([np.stack(first).astype(np.uint32), tails])


def width_of(distinct: int) -> int:
    """The bits of a word's number, if there are so many words, the start and one number for those not in training."""
    return (distinct + 1).bit_length()


def _left_over(width: int) -> int:
    """How many bits of the third word find no place beside the first two in 64."""
    return max(0, 3 * width - 64)


def third_type(width: int) -> str:
    """The narrowest type for these bits."""
    return next(f"<u{n}" for n in (1, 2, 4) if 8 * n >= _left_over(width))


def keyed(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and tails of n-grams of words of ``width`` bits; together they give back the words.

    The first three words fill up the 64 bits that ``gram_key`` makes of two, and
    what is left of the third is the first row of the tails; later words are rows as they are.
    """
    if len(words) < 3:
        return gram_key(words), words[2:]
    low = _left_over(width)
    first, second, third = words[:3].astype(np.uint64)
    rest = third & np.uint64((1 << low) - 1)
    key = mix((((first << np.uint64(width)) | second) << np.uint64(width - low)) | (third >> np.uint64(low)))
    key = mix(key * np.uint64(STEP) + rest)
    for own in words[3:]:
        key = mix(key * np.uint64(STEP) + own)
    return key, np.concatenate([rest[None].astype(np.uint32), words[3:]])


def unkeyed(key: np.ndarray, tails: np.ndarray, level: int, width: int) -> np.ndarray:
    """The words of n-grams: ``keyed`` backwards."""
    if level < 3:
        return words_of(key, tails, level)
    for own in tails[::-1]:
        key = context_key(key, own)
    key, low = _unmix(key), _left_over(width)
    inside, mask = np.uint64(width - low), np.uint64((1 << width) - 1)
    third = ((key << np.uint64(low)) & mask) | tails[0]
    return np.concatenate([np.stack([key >> (inside + np.uint64(width)), (key >> inside) & mask, third]).astype(np.uint32), tails[1:]])


def _grouped(key: np.ndarray, tails=()) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, equal ones by their tails, and where each group begins in it."""

    def heads(order):
        new = np.ones(len(key), bool)
        ordered = key[order]
        new[1:] = ordered[1:] != ordered[:-1]
        other = np.zeros(max(0, len(key) - 1), bool)
        for tail in tails:
            ordered = tail[order]
            other |= ordered[1:] != ordered[:-1]
        met = (other & ~new[1:]).any()  # two n-grams of one hash
        new[1:] |= other
        return met, np.flatnonzero(new)

    order = np.argsort(key)
    met, at = heads(order)
    if met:
        order = np.lexsort((*tails[::-1], key))
        at = heads(order)[1]
    return order, at


def _sums(columns: list[np.ndarray], order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """A row of sums for each group; column by column, as sums of whole rows cost several times as much."""
    return np.column_stack([np.add.reduceat(column[order], heads) if len(heads) else column[:0] for column in columns])


def _by_bucket(key: np.ndarray, bits: int):
    """Bounds of the buckets in sorted keys."""
    cuts = np.append(np.searchsorted(key, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(key))
    for bucket in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        yield bucket, int(cuts[bucket]), int(cuts[bucket + 1])


def _in_round(key: np.ndarray, bits: int, rounds: int, number: int) -> np.ndarray:
    """The places of the keys whose buckets are dealt out in this round: a run of neighbours."""
    first, end = ((at << bits) // rounds << (64 - bits) for at in (number, number + 1))
    return np.flatnonzero(key - np.uint64(first) <= np.uint64(end - first - 1)) if first < end else np.zeros(0, np.int64)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on as a byte each, then those of ``MANY`` and more in full."""
    flat = numbers.reshape(-1)
    return np.minimum(flat, MANY).astype(np.uint8).tobytes() + flat[flat >= MANY].astype("<i8").tobytes()


def unpacked(raw: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, size).astype(np.int64)
    out[out == MANY] = np.frombuffer(raw, "<i8", (len(raw) - size) // 8, size)
    return out


SENT = "bucket int, kind string, keys binary, tails binary, n binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("keys", pa.binary()), ("tails", pa.binary()), ("n", pa.binary())])
COUNTED = "bucket int, distinct long, total long, of_counts array<long>"


def _tail_bytes(tails: np.ndarray, third: str) -> bytes:
    """The rows of fourth and later words, then that of what is left of the third."""
    return b"".join([*(own.tobytes() for own in tails[1:]), *(own.astype(third).tobytes() for own in tails[:1])])


def _tails(raw, size: int, rows: int, at: int = 0, end: int | None = None) -> list[np.ndarray]:
    """The rows of ``_tail_bytes``, as they are stored."""
    if not rows or not size:
        return [np.zeros(size, np.uint32)] * rows
    wide = ((len(raw) if end is None else end) - at) // size - 4 * (rows - 1)
    return [np.frombuffer(raw, f"<u{wide}", size, at + 4 * (rows - 1) * size), *(np.frombuffer(raw, np.uint32, size, at + 4 * i * size) for i in range(rows - 1))]


def _dealt(kind: str, key: np.ndarray, tails: np.ndarray, n: np.ndarray, bits: int, third: str = "<u4"):
    """A row for each bucket of sorted keys."""
    rows = [(b, kind, key[lo:hi].tobytes(), _tail_bytes(tails[:, lo:hi], third), packed(n[lo:hi])) for b, lo, hi in _by_bucket(key, bits)]
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW).to_batches()


def _received(table: pa.Table, level: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = max(0, level - 2)
    keys = [np.frombuffer(raw, np.uint64) for raw in table["keys"].to_pylist()]
    tails = [_tails(raw, len(k), rows) for raw, k in zip(table["tails"].to_pylist(), keys)]
    n = [unpacked(raw, wide * len(k)).reshape(-1, wide) for raw, k in zip(table["n"].to_pylist(), keys)]
    key = np.concatenate([np.zeros(0, np.uint64), *keys])
    joined = np.zeros((rows, len(key)), np.uint32)
    for i in range(rows):
        np.concatenate([np.zeros(0, np.uint32), *(t[i] for t in tails)], out=joined[i])
    return key, joined, np.concatenate([np.zeros((0, wide), np.int64), *n])


def _count_words(bits: int):
    def run(batches):
        for batch in filled(batches):
            for part in slices(batch.column("text"), SCORED_BYTES):
                key, n = np.unique(tokens(part)[0], return_counts=True)
                yield from _dealt("word", key, np.zeros((0, len(key)), np.uint32), n, bits)

    return run


def _store(path: str, key: np.ndarray, tails: np.ndarray, numbers: np.ndarray, third: str) -> None:
    """Sorted keys with their tails and a row of numbers each."""
    flat = numbers.reshape(-1)
    many = np.flatnonzero(flat >= MANY)
    head = np.array([len(key), numbers.shape[1], len(many), len(tails)], "<i8")
    parts = (head, key, many.astype("<i8"), flat[many].astype("<i8"), np.minimum(flat, MANY).astype(np.uint8))
    *first, last = (x.tobytes() for x in parts)
    put(path, lambda out: [out.write(x) for x in (*first, _tail_bytes(tails, third), last)])


def _add_up(folder: str, level: int, top: bool, third: str):
    """Add up one bucket of words (level 0) or n-grams and write its file.

    Its numbers are the count and, below the ``top``, of the n-gram as a context
    the count and the followers counted once, twice and more often.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        key, tails, n = _received(table.filter(pc.not_equal(table["kind"], "context")), level, 1)
        columns = [n[:, 0]]
        if not top:
            others = _received(table.filter(pc.equal(table["kind"], "context")), level, 4)
            columns = [np.pad(n[:, 0], (0, len(others[0]))), *(np.pad(own, (len(key), 0)) for own in others[2].T)]
            key, tails = np.concatenate([key, others[0]]), np.concatenate([tails, others[1]], axis=1)
        at, heads = _grouped(key, tails)
        n, at = _sums(columns, at, heads), at[heads]
        _store(f"{folder}/grams{level}-{bucket:06d}", key[at], tails[:, at], n, third)
        own = n[:, 0]
        of_counts = [*(int((own == i).sum()) for i in (1, 2, 3, 4)), int((own > 2).sum())]
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "distinct": [len(own)], "total": [int(own.sum())], "of_counts": pa.array([of_counts], pa.list_(pa.int64()))})

    return run


class Stored:
    """The files of a model, mapped as they are needed."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.arrays = folder, bits, {}

    def file(self, level: int, bucket: int):
        """Keys, tails, and numbers as bytes, places and full numbers; None if nothing fell into the bucket."""
        if (level, bucket) not in self.arrays:
            if len(self.arrays) >= MAPPED:
                self.arrays.clear()
            try:
                raw = mapped(f"{self.folder}/grams{level}-{bucket:06d}")
            except FileNotFoundError:
                self.arrays[level, bucket] = None
                return None
            n, wide, many, tails = (int(x) for x in np.frombuffer(raw, "<i8", 4))
            at = 32 + 8 * n
            self.arrays[level, bucket] = (
                np.frombuffer(raw, np.uint64, n, 32),
                _tails(raw, n, tails, at + 16 * many, raw.size - n * wide),
                np.frombuffer(raw, np.uint8, n * wide, raw.size - n * wide).reshape(n, wide),
                np.frombuffer(raw, "<i8", many, at),
                np.frombuffer(raw, "<i8", many, at + 8 * many),
            )
        return self.arrays[level, bucket]

    @staticmethod
    def numbers(held, at: np.ndarray, wide: int) -> np.ndarray:
        """The first ``wide`` numbers of the n-grams at these places."""
        _, _, small, many, full = held
        out = small[:, :wide].take(at, axis=0).astype(np.int64)
        if len(many):
            row, column = np.divmod(np.flatnonzero(out == MANY), wide)
            out[row, column] = full[np.searchsorted(many, at[row] * small.shape[1] + column)]
        return out

    def look_up(self, level: int, key: np.ndarray, tails: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted n-grams the places in their files (-1: not there) and the stored numbers (0: not there)."""
        place, out = np.full(len(key), -1), np.zeros((len(key), wide), np.int64)
        for bucket, lo, hi in _by_bucket(key, self.bits):
            held = self.file(level, bucket)
            if held is None:
                continue
            keys, their = held[:2]
            at = np.searchsorted(keys, key[lo:hi])
            asked = np.flatnonzero(keys.take(at, mode="clip") == key[lo:hi])
            at, asked = at[asked], asked + lo
            while len(asked):  # more than once only where n-grams share a hash
                same = np.ones(len(asked), bool)
                for one, other in zip(their, tails):
                    same &= one[at] == other[asked]
                found, there = (asked, at) if same.all() else (asked[same], at[same])
                place[found], out[found] = there, self.numbers(held, there, wide)
                asked, at = asked[~same], at[~same] + 1
                more = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == key[asked])
                asked, at = asked[more], at[more]
        return place, out

    def of(self, level: int, key: np.ndarray, tails: np.ndarray, wide: int) -> tuple[np.ndarray, ...]:
        """Each n-gram's number among the different ones, and of these the keys, places and stored numbers."""
        order, heads = _grouped(key, tails)
        group = np.empty(len(key), np.int32)
        group[order] = np.repeat(np.arange(len(heads), dtype=np.int32), np.diff(np.append(heads, len(key))))
        first = order[heads]
        return group, key[first], *self.look_up(level, key[first], tails[:, first], wide)

    def numbered(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's place among the different ones, and of these the numbers and the counts in training."""
        bases = np.frombuffer(mapped(f"{self.folder}/bases"), "<i8")
        group, key, place, count = self.of(0, own, np.zeros((0, len(own)), np.uint32), 1)
        number = bases[(key >> np.uint64(64 - self.bits)).astype(np.int64)] + place
        return group, np.where(place < 0, UNKNOWN, number.astype(np.uint32)), count[:, 0]


def _number(folder: str, bits: int):
    """Texts as the numbers of their words, a row for each slice."""

    def run(batches):
        words = Stored(folder, bits)
        for batch in filled(batches):
            rows = []
            for part in slices(batch.column("text"), SCORED_BYTES):
                own, bounds = tokens(part)
                group, number, _ = words.numbered(own)
                rows.append((number[group].tobytes(), bounds.astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["numbers", "bounds"])

    return run


def _count(bits: int, order: int, rounds: int, number: int, width: int):
    def send(held):
        key, tails = keyed(np.concatenate(held, axis=1), width)
        here = _in_round(key, bits, rounds, number)
        key, tails = key[here], tails[:, here]
        at, heads = _grouped(key, tails)
        n, at = np.diff(np.append(heads, len(key))), at[heads]
        yield from _dealt("grams", key[at], tails[:, at], n, bits, third_type(width))

    def run(batches):
        held, size = [], 0
        for batch in filled(batches):
            for numbers, bounds in zip(batch.column("numbers"), batch.column("bounds")):
                held.append(ngrams(np.frombuffer(numbers.as_buffer(), np.uint32), np.frombuffer(bounds.as_buffer(), "<i8"), order))
                size += held[-1].shape[1]
                if size >= FLUSH_TOKENS:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    return run


def _tell(folder: str, bits: int, level: int, rounds: int, number: int, width: int):
    """From the files of n-grams, what contexts and shorter n-grams are told that are dealt out in this round."""

    def run(batches):
        for batch in filled(batches):
            for bucket in batch.column("id").to_pylist():
                held = Stored(folder, bits).file(level, bucket)
                if held is None:
                    continue
                key, n = held[0], held[2][:, 0]
                tails = np.array(held[1], np.uint32).reshape(max(0, level - 2), len(key))
                words = unkeyed(key, tails, level, width)
                # A longer context's key stands in that of its n-gram.
                contexts = (context_key(key, tails[-1]), tails[:-1]) if level > 3 else keyed(words[:-1], width)
                for kind, (key, tails) in (("context", contexts), ("grams", keyed(words[1:], width))):
                    here = _in_round(key, bits, rounds, number)
                    here = here[n[here] > 0]  # others are contexts only
                    key, tails = key[here], tails[:, here]
                    at, heads = _grouped(key, tails)
                    if kind == "context":
                        own = Stored.numbers(held, here, 1)[:, 0]
                        told = _sums([own, *(x.astype(np.int64) for x in (own == 1, own == 2, own > 2))], at, heads)
                    else:
                        told = np.diff(np.append(heads, len(key)))
                    yield from _dealt(kind, key[at[heads]], tails[:, at[heads]], told, bits, third_type(width))

    return run


def discounts(n: list[int]) -> list[float]:
    """Of counts 1, 2 and 3 or more, from how many things are counted 1, 2, 3 and 4 times."""
    if not n[0] or not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    out = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1] if n[2] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] and n[3] else 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(out)]


def fit(docs: DataFrame, folder: str | None = None, order: int = ORDER, rounds: int = ROUNDS) -> str:
    """Count the n-grams of ``order`` words of the texts of ``docs`` and write the model; returns its folder.

    Only ``text`` is looked at. Null and empty texts are their end alone. What a
    shuffle of n-grams holds at a time is divided by ``rounds`` (half as many
    for single words); the model is the same for any number. At most 2**32 - 2
    different words can be numbered; more are refused.
    """
    if order < 2 or rounds < 1:
        raise ValueError("order is 2 or more, rounds 1 or more")
    spark, own = docs.sparkSession, docs.select(F.col("text").cast("string").alias("text"))
    folder = qualified(spark, folder or scratch_path(spark, "model"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Buckets follow the text alone: a bucket sends a row to each bucket of the level below, so more of them than that are rows for nothing.
    bits = max(math.ceil(math.log2(max(1, size / BUCKET_BYTES))), LEAST_BITS)

    def added(sent: DataFrame, level: int) -> DataFrame:
        return saved(spark, sent.groupBy("bucket").applyInArrow(_add_up(folder, level, level in (0, order), third), COUNTED), "counts")

    def summed(parts: list[DataFrame]) -> list[int]:
        """Distinct n-grams, their counts, how many are counted 1, 2, 3, 4 times and 3 times or more."""
        rows = [part.agg(F.sum("distinct"), F.sum("total"), *(F.sum(F.col("of_counts")[i]) for i in range(5))).first() for part in parts]
        return [sum(r[i] or 0 for r in rows) for i in range(7)]

    third = "<u4"  # until the words are counted
    words = added(own.mapInArrow(_count_words(bits), SENT), 0)
    held = np.zeros(1 << bits, np.int64)
    for row in words.select("bucket", "distinct").collect():  # a row per bucket
        held[row["bucket"]] = row["distinct"]
    if held.sum() > 0xFFFFFFFE:
        raise ValueError("too many different words to number")
    put(f"{folder}/bases", lambda out: out.write((1 + np.cumsum(held) - held).astype("<i8").tobytes()))
    distinct, total, *_ = summed([words])
    width = width_of(distinct)
    third = third_type(width)

    numbered = scratch_path(spark, "numbers")
    own.mapInArrow(_number(folder, bits), "numbers binary, bounds binary").write.parquet(numbered)
    numbers = spark.read.parquet(numbered)
    counts = {order: summed([added(numbers.mapInArrow(_count(bits, order, rounds, number, width), SENT), order) for number in range(rounds)])}
    removed(spark, numbered)
    buckets = spark.range(0, 1 << bits, 1, min(1 << bits, READERS))
    for level in range(order, 1, -1):
        parts = rounds if level > 2 else -(-rounds // 2)  # pairs are fewer, and tell a word no more than once a bucket
        told = (buckets.mapInArrow(_tell(folder, bits, level, parts, number, width), SENT) for number in range(parts))
        counts[level - 1] = summed([added(sent, level - 1) for sent in told])
    meta = {
        "order": order,
        "bits": bits,
        "width": width,
        "tokens": total,
        "distinct": distinct,
        "pairs": counts[1][1],
        "discounts": [discounts(counts[level][2:6]) for level in range(1, order + 1)],
        "of_words": counts[1][2:],
    }
    put(f"{folder}/model.json", lambda out: out.write(json.dumps(meta).encode()))
    return folder


class Model:
    """A stored model."""

    def __init__(self, folder: str):
        self.meta = json.loads(mapped(f"{folder}/model.json").to_pybytes())
        self.stored = Stored(folder, self.meta["bits"])

    def log_shares(self, own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token its count in training, and the log10 of its share after the ones before it."""
        m = self.meta
        order, cut = m["order"], [np.array([0.0, *d]) for d in m["discounts"]]
        word, number, count = self.stored.numbered(own)
        number = np.minimum(number, UNKNOWN >> np.uint32(32 - m["width"]))  # the largest of that width is no word's
        words, first = ngrams(number[word], bounds, order), np.full((order, 1), START)

        def stored(level, grams):
            """Of n-grams each one's place among the different ones, and of these the counts."""
            group, _, _, found = self.stored.of(level, *keyed(grams, m["width"]), 1 if level == order else 5)
            return group, found

        def as_context(level, found):
            """Of different n-grams the count as a context, and what the discounts of those that follow leave over."""
            d = cut[level]
            return found[:, 1], found[:, 2] * d[1] + found[:, 3] * d[2] + found[:, 4] * d[3]

        # Figures are made for different n-grams and dealt out to the tokens; words are sorted once.
        again, found = stored(1, number[None])
        group = again[word]
        even = 1.0 / (m["distinct"] + 1)
        if m["pairs"]:
            n, d = found[:, 0], cut[0]
            n1, n2, _, _, n3 = m["of_words"]
            spare = (d[1] * n1 + d[2] * n2 + d[3] * n3) / m["pairs"]
            p = ((n - d[np.minimum(n, 3)]) / m["pairs"] + spare * even)[group]
        else:
            p = np.full(len(own), even)
        for level in range(2, order + 1):
            # The context of a token is the shorter n-gram that ends one place before it.
            start = as_context(level - 1, stored(level - 1, first[: level - 1])[1])
            total, left = (shifted(x[group], bounds, s[0]) for x, s in zip(as_context(level - 1, found), start))
            group, found = stored(level, words[order - level :])
            n = found[:, 0]
            share = ((n - cut[level - 1][np.minimum(n, 3)])[group] + left * p) / np.maximum(total, 1)
            p = np.where(total > 0, share, p)
        return count[word], np.log10(p)


def score(docs: DataFrame, folder: str) -> DataFrame:
    """Add ``n_tokens, n_known, train_tokens, base_score, score`` to ``docs``.

    ``score`` is the log10 of a text's probability, its end included, so
    perplexity is ``10 ** (-score / n_tokens)``; ``base_score`` that of a model
    of single words with one added to each count. Null and empty texts are their
    end alone; a model without texts gives every token the same share. An input
    column named like an added one gives way.
    """
    schema, folder = with_columns(docs.schema, *ADDED), qualified(docs.sparkSession, folder)

    def run(batches):
        cache = worker_cache()
        if cache.get("model", (None,))[0] != folder:
            cache["model"] = (folder, Model(folder))
        model = cache["model"][1]
        m = model.meta
        for batch in filled(batches):
            made = {f.name: [] for f in ADDED}
            for part in slices(batch.column("text"), SCORED_BYTES):
                own, bounds = tokens(part)
                count, share = model.log_shares(own, bounds)
                base = np.log10((count + 1) / (m["tokens"] + m["distinct"] + 1))
                add = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every row has a token
                for name, value in zip(made, (np.diff(bounds), add((count > 0).astype(np.int64)), np.full(len(bounds) - 1, m["tokens"]), add(base), add(share))):
                    made[name].append(pa.array(value))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(made[f.name]) if f.name in made else batch.column(f.name) for f in schema.fields], names=schema.names)

    return docs.mapInArrow(run, schema)
