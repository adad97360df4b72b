"""Operator 3, benchmark decontamination with one Aho-Corasick automaton.

Windows of the normalised benchmark items, each between blanks, are the
automaton's patterns. A document is normalised byte by byte (so places in it are
places in the original) and its words, joined by one blank, are scanned once;
every occurrence marks its words. The automaton is made once per worker from
patterns whose bytes, and so its nodes, are bounded: a benchmark too large for
one goes over the documents in several blocks of windows, one after the other,
without a shuffle.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from darwise.llm.exchange import saved
from darwise.llm.tables import with_columns
from darwise.llm.text import filled, slices, worker_cache

WINDOW = 13
NODES = 4 << 20  # of one automaton; each takes about 50 bytes in every Python worker
PATTERNS_SENT = 10_000  # rows of a batch
CONTAMINATED_SHARE = 20  # one word in so many hit makes a document contaminated

# Words are runs of letters, digits and anything beyond ASCII; A-Z in lower case.
NORMAL = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
NORMAL_ARRAY = np.frombuffer(NORMAL, np.uint8)
BLANK = np.zeros(256, bool)
BLANK[32] = True

FOUND = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = (
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", SPAN), T.StructField("contaminated", T.BooleanType()),
)


def _windows(window: int):
    """Rows of items as rows of patterns: blanks around each word, the number of words, the item."""

    def run(batches):
        for batch in filled(batches):
            made = ([], [], [])
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = (text or "").encode().translate(NORMAL).split()
                for at in range(max(1, len(words) - window + 1) if words else 0):
                    own = words[at : at + window]
                    for column, value in zip(made, (b" " + b" ".join(own) + b" ", len(own), str(item))):
                        column.append(value)
                    if len(made[0]) == PATTERNS_SENT:
                        yield _patterns(made)
                        made = ([], [], [])
            yield _patterns(made)

    return run


def _patterns(made) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(made[0], pa.binary()), pa.array(made[1], pa.int32()), pa.array(made[2], pa.string())], names=["pattern", "n", "item"])


def pattern_blocks(items: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text", nodes: int = NODES) -> list[DataFrame]:
    """The windows of all items, as ``pattern, n, item``, in blocks of about ``nodes`` bytes.

    An automaton has at most one node for each byte of its patterns, so this
    bounds it. Windows are dealt out by a hash, so a long item is split as well.
    """
    own = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    every = saved(items.sparkSession, own.mapInArrow(_windows(window), "pattern binary, n int, item string").distinct(), "patterns")
    size = every.agg(F.sum(F.octet_length("pattern") + F.octet_length("item"))).first()[0] or 0
    n = -(-5 * size // (4 * nodes)) or 1  # a fifth of room, as hashes deal unevenly
    return [every.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == b) if n > 1 else every for b in range(n)]


def _by_pattern(block: DataFrame) -> dict[str, tuple[int, list[str]]]:
    """Pattern (bytes shown as Latin-1) to its number of words and the items with it."""
    patterns: dict[str, tuple[int, list[str]]] = {}
    for r in block.toLocalIterator():
        patterns.setdefault(bytes(r.pattern).decode("latin-1"), (r.n, []))[1].append(r.item)
    return patterns


def _automaton(key: str, patterns):
    cache = worker_cache()
    if cache.get("automaton", ("",))[0] != key:
        import ahocorasick

        made = ahocorasick.Automaton()
        for pattern, value in patterns.value.items():
            made.add_word(pattern, value)
        made.make_automaton()
        cache["automaton"] = (key, made)
    return cache["automaton"][1]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, item_col: str = "item_id", item_text_col: str = "text", nodes: int = NODES) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``item_ids``, ``hit_spans`` and ``contaminated`` to ``docs`` (``text``, more columns).

    A window is ``window`` consecutive words of an item, or all words of a
    shorter item; words inside any occurrence in a document are hit. ``item_ids``
    are the items with occurring windows, sorted as strings; ``hit_spans`` are
    byte bounds of the maximal hit runs in the UTF-8 of the original text. Null
    and empty texts have no words and are clean; items without words match
    nothing; an input column named like an added one gives way.
    """
    spark, out = docs.sparkSession, docs
    blocks = pattern_blocks(items, window, item_col, item_text_col, nodes)
    schema = with_columns(docs.schema, T.StructField("_runs", FOUND), T.StructField("_items", T.ArrayType(T.StringType())))
    for number, block in enumerate(blocks):
        sent = spark.sparkContext.broadcast(_by_pattern(block))
        scan = _scan(sent, uuid.uuid4().hex, schema, first=number == 0)
        if number < len(blocks) - 1:
            out = out.mapInArrow(scan, schema)
    final = with_columns(docs.schema, *ADDED)

    def finish(batches):
        for batch in filled(batches):
            made = {f.name: [] for f in ADDED}
            for part in slices(batch.column("text")):
                starts, ends, first = _words(part)
                runs, items_of = (batch.column(c).slice(part.lo, part.hi - part.lo).to_pylist() for c in ("_runs", "_items"))
                n_words = np.diff(first)
                for row, (own, found) in enumerate(zip(runs, items_of)):
                    hit, spans, end = 0, [], 0
                    for a, b in sorted((r["first"], r["end"]) for r in own):
                        hit += max(0, b - max(a, end))
                        at, to = int(starts[first[row] + a] - part.off[row]), int(ends[first[row] + b - 1] - part.off[row])
                        if spans and a <= end:
                            spans[-1]["end"] = max(spans[-1]["end"], to)
                        else:
                            spans.append({"start": at, "end": to})
                        end = max(end, b)
                    for name, value in zip(made, (int(n_words[row]), hit, sorted(set(found)), spans, hit > 0 and CONTAMINATED_SHARE * hit >= int(n_words[row]))):
                        made[name].append(value)
            columns = [pa.array(made[f.name], _ARROW[f.name]) if f.name in made else batch.column(f.name) for f in final.fields]
            yield pa.RecordBatch.from_arrays(columns, names=final.names)

    # The last scan and the sums are one pass: one Python worker for a task.
    return out.mapInArrow(lambda batches: finish(scan(batches)), final)


_ARROW = {
    "n_words": pa.int64(), "n_hit": pa.int64(), "item_ids": pa.list_(pa.string()),
    "hit_spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "contaminated": pa.bool_(),
}
_RUN = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _words(part):
    part.data = NORMAL_ARRAY[part.data]
    return part.words(BLANK)


def _scan(patterns, key: str, schema: T.StructType, first: bool):
    def scan(batches):
        automaton = _automaton(key, patterns)
        for batch in filled(batches):
            runs = [[] for _ in range(batch.num_rows)] if first else batch.column("_runs").to_pylist()
            items = [[] for _ in range(batch.num_rows)] if first else batch.column("_items").to_pylist()
            for part in slices(batch.column("text")) if len(automaton) else ():
                data = part.data.tobytes().translate(NORMAL)
                for row, (a, b) in enumerate(zip(part.off[:-1], part.off[1:]), part.lo):
                    words = data[a:b].split()
                    text = (b" " + b" ".join(words) + b" ").decode("latin-1")
                    hits = list(automaton.iter(text))
                    if hits:
                        blanks = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
                        for place, (n, found) in hits:
                            end = int(np.searchsorted(blanks, place))  # words before this blank
                            runs[row].append({"first": end - n, "end": end})
                            items[row] += found
                        items[row] = list(set(items[row]))
            added = {"_runs": pa.array(runs, _RUN), "_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([added[f.name] if f.name in added else batch.column(f.name) for f in schema.fields], names=schema.names)

    return scan


