"""Operator 12, the prefix trie of conversations by an Euler tour.

Turns are compared by digests; texts are never shuffled. Running sums of digests
in the order of the turns name every prefix, and equal prefixes are one node. A
node has two arcs, one that enters its subtree and one that leaves it; the arcs
of all nodes are one list, children in the order of their smallest
conversation. The list is ranked (``listrank``), and running sums at the arcs'
places give what each subtree holds: what was summed between its two arcs.
"""

import hashlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from darwise.llm.exchange import saved
from darwise.llm.listrank import CHUNK, LAST, ranked
from darwise.llm.running import running
from darwise.llm.tables import partitions
from darwise.llm.text import filled

WORD = r"[^\x20\x09-\x0D]+"
#: A prefix is named by sums modulo four primes below 2**31, each of digest bits times a power of a fixed base.
PRIMES = [2147483647, 2147483629, 2147483587, 2147483579]
BASES = [int(b) for b in np.random.default_rng(12).integers(10**8, 2 * 10**9, 4)]
SUMS = ["s0", "s1", "s2", "s3"]
TERMS = ["t0", "t1", "t2", "t3"]
EMPTY = hashlib.sha256(b"").hexdigest()


class Conversations(NamedTuple):
    ids: DataFrame  # conv_id, of conversations without turns too
    turns: DataFrame  # conv_id, depth (from 1), d0, d1 (digest of role and text), words


def conversations(df: DataFrame) -> Conversations:
    """Turns numbered within their conversation, and what they say as digests.

    ``df`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are
    not looked at. Rows without a conv_id belong to no conversation and are left
    out. Turns stand in the order of ``turn``, nulls first; equal turn numbers by
    a digest of role and text, so repeated rows stand side by side and each
    counts. Null roles and texts are empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    part = lambda c, start: F.conv(F.substring(c, start, 15), 16, 10).cast("long")  # noqa: E731  60 bits
    rows = df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), said.alias("_d"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = rows.select("conv_id", "_turn", part("_d", 1).alias("d0"), part("_d", 16).alias("d1"), "words", F.lit(1).cast("long").alias("depth"))
    turns = saved(df.sparkSession, running(rows, ["conv_id"], ["_turn", "d0", "d1"], ["depth"]).select("conv_id", "depth", "d0", "d1", "words"), "turns")
    return Conversations(turns.select("conv_id").distinct(), turns)


def rebuilt(df: DataFrame, family: int, shared: Callable[[Column], Column], most: int) -> Conversations:
    """Conversations that begin like the first of their family.

    Conversation ``c`` gets the first ``h = shared(c)`` turns, ``most`` of them
    at most, of conversation ``c - c % family`` (all of them if it has fewer,
    none if there is none), then its own turns after its first ``h``.
    """
    every = conversations(df)
    c = F.col("conv_id")
    lengths = every.turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    plan = lengths.select("conv_id", (c - c % family).alias("base"), F.least(shared(c), F.lit(most)).cast("long").alias("h"))
    first = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("_n"))
    plan = saved(df.sparkSession, plan.join(first, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("_n", F.lit(0))).alias("taken")), "plan")
    lent = every.turns.where(F.col("depth") <= most).withColumnRenamed("conv_id", "base")
    taken = plan.join(lent, "base").where("depth <= h").select("conv_id", "depth", "d0", "d1", "words")
    own = every.turns.join(plan, "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "d0", "d1", "words")
    return Conversations(plan.select("conv_id"), taken.unionByName(own))


def _terms(turns: DataFrame) -> DataFrame:
    """What each turn adds to the sums that name prefixes."""
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("words", T.LongType())] + [T.StructField(c, T.LongType()) for c in TERMS])

    def run(batches):
        for batch in filled(batches):
            depth, d0, d1 = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.uint64) for c in ("depth", "d0", "d1"))
            bits = [d0 >> np.uint64(30), d0 & np.uint64((1 << 30) - 1), d1 >> np.uint64(30), d1 & np.uint64((1 << 30) - 1)]
            made = {c: batch.column(c) for c in ("conv_id", "depth", "words")}
            for name, value, prime, base in zip(TERMS, bits, PRIMES, BASES):
                p, square, power, left = np.uint64(prime), np.uint64(base), np.ones(len(depth), np.uint64), depth.copy()
                while left.any():
                    power = np.where(left & np.uint64(1), power * square % p, power)
                    square, left = square * square % p, left >> np.uint64(1)
                # No turn adds nothing.
                made[name] = pa.array(((value % (p - np.uint64(1)) + np.uint64(1)) * power % p).astype(np.int64))
            yield pa.RecordBatch.from_pydict(made)

    return turns.mapInArrow(run, schema)


def _pair(parts: list[Column]) -> Column:
    """Four sums as two longs."""
    return F.struct((parts[0] * 2**31 + parts[1]).alias("a"), (parts[2] * 2**31 + parts[3]).alias("b"))


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, words, name, above``: the names of the prefix that ends with each turn and of the one before."""
    terms = _terms(turns)
    sums = running(terms.select("*", *(F.col(t).alias(s) for t, s in zip(TERMS, SUMS))), ["conv_id"], ["depth"], SUMS, PRIMES)
    above = [(F.col(s) - F.col(t) + p) % p for s, t, p in zip(SUMS, TERMS, PRIMES)]
    return sums.select("conv_id", "depth", "words", _pair([F.col(s) for s in SUMS]).alias("name"), _pair(above).alias("above"))


def _ends(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``depth, name, ends_sha256`` of the nodes where conversations end.

    Ids are dealt out by ranges and written side by side there; only these
    pieces of text come together, in order, and go through the digest one by one.
    """
    no_turns = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "name.a", "name.b")).alias("e"))
    ends = ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("e", no_turns).alias("e")).select("conv_id", "e.depth", "e.a", "e.b")
    n, key = partitions(rows), ["depth", "a", "b"]

    def runs_of(batch):
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in key]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        at = np.flatnonzero(new)
        return zip(at, np.append(at[1:], batch.num_rows))

    def write(batches):
        for batch in filled(batches):
            ids, spans = batch.column("conv_id"), list(runs_of(batch))
            first = pa.array([a for a, _ in spans])
            texts = ids.cast(pa.string()).to_pylist()
            yield pa.RecordBatch.from_pydict({c: batch.column(c).take(first) for c in key} | {"first": ids.take(first), "ids": pa.array([",".join(texts[a:b]) for a, b in spans])})

    def digest(batches):
        at, held, out = None, None, []

        def flush():
            made = pa.RecordBatch.from_pydict({c: pa.array([o[0][i] for o in out], pa.int64()) for i, c in enumerate(key)} | {"ends_sha256": pa.array([o[1] for o in out], pa.string())})
            out.clear()
            return made

        for batch in filled(batches):
            for *own, text in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if own == at:
                    held.update(b",")
                else:
                    if at is not None:
                        out.append((at, held.hexdigest()))
                    at, held = own, hashlib.sha256()
                held.update(text.encode())
            yield flush()
        if at is not None:
            out.append((at, held.hexdigest()))
            yield flush()

    pieces = ends.repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(write, "depth long, a long, b long, first long, ids string")
    found = pieces.repartition(n, *key).sortWithinPartitions(*key, "first").mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")
    return found.select("depth", F.struct("a", "b").alias("name"), "ends_sha256")


def prefix_trie(every: Conversations, chunk: int = CHUNK, last: int = LAST) -> DataFrame:
    """One row per distinct prefix of the conversations, the empty one included.

    ``conv_id`` (smallest conversation that begins so), ``depth`` (turns),
    ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves`` (nodes without children in the subtree, itself included),
    ``saved_tokens`` (over the subtree, the words of a node's last text times the
    conversations beyond the first), ``ends_sha256`` (of the ids of the
    conversations that end here, in order, with commas). A conversation without
    turns ends at the root. No conversations, no rows. ``chunk`` and ``last`` are
    those of the list ranking.
    """
    spark = every.ids.sparkSession
    rows = saved(spark, prefixes(every.turns), "prefixes")
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    nodes = rows.groupBy("depth", "name").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.min("above").alias("above"))
    root = every.ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), zero.alias("name"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("above"))
    nodes = saved(spark, nodes.unionByName(root).withColumn("node", F.monotonically_increasing_id()), "nodes")
    start = nodes.where("depth = 0").select("node").first()
    if start is None:
        return nodes.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", *(F.col("n_convs").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")), F.lit(EMPTY).alias("ends_sha256"))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("above"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("depth > 0").join(parents, ["depth", "above"])
    # Places among the children of a node, from 1, in the order of their smallest conversation.
    children = children.select("node", "parent", "parent_conv_id", "conv_id", F.lit(1).cast("long").alias("place"))
    children = saved(spark, running(children, ["parent"], ["conv_id"], ["place"]), "children")
    families = children.groupBy("parent").agg(F.max("place").alias("n_children"), F.min_by("node", "place").alias("first"))
    following = children.select("parent", (F.col("place") - 1).alias("place"), F.col("node").alias("sibling"))
    linked = children.join(following, ["parent", "place"], "left").select("node", "parent", "parent_conv_id", "sibling")
    tree = nodes.join(linked, "node", "left").join(families.withColumnRenamed("parent", "node"), "node", "left").fillna(0, ["n_children"])
    tree = saved(spark, tree, "tree")

    enter, leave = F.col("node") * 2, F.col("node") * 2 + 1
    into = F.struct(enter.alias("id"), F.coalesce(F.col("first") * 2, leave).alias("next"))
    out = F.struct(leave.alias("id"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"))
    # Along a conversation, and from one to the next, arcs follow each other in the tour.
    arcs = tree.repartitionByRange(partitions(tree), "conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    arcs = arcs.select(F.inline(F.array(into, out))).withColumn("weight", F.lit(1).cast("long"))
    places = ranked(arcs, start["node"] * 2, chunk, last).select(F.expr("id div 2").alias("node"), (F.col("id") % 2 == 0).alias("enters"), "at")

    leaf = (F.col("n_children") == 0).cast("long")
    held = tree.select("node", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    own = lambda c: F.when(F.col("enters"), F.col(c)).otherwise(0)
    tour = places.join(held, "node").select(F.lit(0).cast("long").alias("_tour"), "at", "node", "enters", *(own(c).alias(c) for c in ("n_leaves", "saved_tokens")), *(own(c).alias(f"_{c}") for c in ("n_leaves", "saved_tokens")))
    sums = running(tour, ["_tour"], ["at"], ["n_leaves", "saved_tokens"])
    between = lambda c: F.sum(F.when(F.col("enters"), F.col(f"_{c}") - F.col(c)).otherwise(F.col(c))).alias(c)
    inside = sums.groupBy("node").agg(between("n_leaves"), between("saved_tokens"))
    whole = tree.join(inside, "node").join(_ends(rows, every.ids), ["depth", "name"], "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
