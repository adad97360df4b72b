"""Places of the elements of a linked list that is held in a table."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from darwise.llm.exchange import saved
from darwise.llm.text import filled

CHUNK = 1 << 16  # elements whose runs a task joins at once
LAST = 1 << 14  # elements that are ranked in one task at the end
RATE = 32  # one element of so many divides the list
PLACED = "id long, head long, off long, next long, weight long"


def runs(ids: np.ndarray, nxt: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each element the index of the first of its run, the weight of the run before it, and whether it is the run's last.

    A run is a maximal stretch of the list whose elements are all here.
    """
    n, order = len(ids), np.argsort(ids)
    at = np.minimum(np.searchsorted(ids, nxt, sorter=order), n - 1)
    to = np.where((nxt >= 0) & (ids[order[at]] == nxt), order[at], -1)
    head, off = np.arange(n), np.zeros(n, np.int64)
    inside = np.flatnonzero(to >= 0)
    head[to[inside]], off[to[inside]] = inside, weight[inside]
    while True:
        further = head[head]
        if (further == head).all():
            return head, off, to < 0
        off, head = off + off[head], further


def joined(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``id, head, off`` of the runs within chunks of consecutive rows; a run's last row has ``next`` and the run's ``weight``.

    ``df`` has ``id``, ``next`` (null at the end) and ``weight``, all longs of 0 or more.
    """

    def close(held):
        batch = pa.Table.from_batches(held).combine_chunks()
        ids, weight = (batch[c].to_numpy() for c in ("id", "weight"))
        nxt = batch["next"].fill_null(-1).to_numpy()
        head, off, last = runs(ids, nxt, weight)
        end = pa.array(np.where(last, nxt, -1), mask=~last | (nxt < 0))
        return pa.RecordBatch.from_pydict({"id": pa.array(ids), "head": pa.array(ids[head]), "off": pa.array(off), "next": end, "weight": pa.array(np.where(last, off + weight, 0), mask=~last)})

    def run(batches):
        held, size = [], 0
        for batch in filled(batches):
            held, size = held + [batch], size + batch.num_rows
            if size >= chunk:
                yield close(held)
                held, size = [], 0
        if size:
            yield close(held)

    return df.select("id", "next", "weight").mapInArrow(run, PLACED)


def ranked(elements: DataFrame, start: int, chunk: int = CHUNK, last: int = LAST) -> DataFrame:
    """``(id, at)``: the weight of what stands before each element of the list that begins at ``start``.

    First every task joins the runs among neighbouring rows: sort ``elements``
    so that neighbours in the list are often neighbours in the table, and little
    is left. What is left is ranked by ``divided``. A table without rows has no
    places.
    """
    spark = elements.sparkSession
    placed = saved(spark, joined(elements, chunk), "runs")
    left = placed.where("weight is not null").select(F.col("head").alias("id"), "next", "weight")
    found = divided(left, start, last)
    return placed.join(found.withColumnRenamed("id", "head"), "head").select("id", (F.col("at") + F.col("off")).alias("at"))


def divided(elements: DataFrame, start: int, last: int = LAST, level: int = 0) -> DataFrame:
    """``(id, at)`` for any list, neighbours or not.

    One element of ``RATE``, by hash, and the first one divide the list. All
    others double their reach until it ends at a divider: about ``log2`` of the
    longest stretch in rounds, whatever the length of the list. The dividers are
    a list of their own, ranked the same way until ``last`` elements are left,
    which one task walks.
    """
    spark = elements.sparkSession
    now = saved(spark, elements, "elements")
    n, total = now.agg(F.count(F.lit(1)), F.sum("weight")).first()
    if n <= last:
        # One chunk, and so one run from the start.
        return joined(now.coalesce(1), chunk=last + 1).select("id", F.col("off").alias("at"))

    def divides(c):
        return (F.pmod(F.xxhash64(c, F.lit(level)), F.lit(RATE)) == 0) | (c == start)

    is_open = F.col("next").isNotNull() & ~divides(F.col("next"))
    while now.where(is_open).limit(1).count():
        beyond = now.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("weight").alias("_weight"))
        further = now.where(is_open).join(beyond, "next").select("id", F.col("_next").alias("next"), (F.col("weight") + F.col("_weight")).alias("weight"))
        now = saved(spark, now.where(~is_open).unionByName(further), "elements")
    found = saved(spark, divided(now.where(divides(F.col("id"))), start, last, level + 1), "dividers")
    ahead = found.select(F.col("id").alias("next"), F.col("at").alias("_at"))
    # The last stretch counts back from the end.
    others = now.where(~divides(F.col("id"))).join(ahead, "next", "left").select("id", (F.coalesce("_at", F.lit(total)) - F.col("weight")).alias("at"))
    return found.unionByName(others)
