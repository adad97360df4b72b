"""Running sums in a global order, whatever share of the rows one key has."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from darwise.llm.exchange import saved
from darwise.llm.tables import partitions
from darwise.llm.text import filled


def running(df: DataFrame, key: list[str], order: list[str], sums: list[str], modulus: list[int] | None = None) -> DataFrame:
    """``df`` with each column of ``sums`` (longs) replaced by its sum up to the row, within equal ``key`` (longs) and by ``order``.

    Rows are dealt out by ranges of key and order, so a hot key fills several
    partitions. Each sums its own rows; what a key had in the partitions before
    is added from one row per partition. With ``modulus`` sums are taken modulo
    one number below 2**31 for each column, as the values must be.
    """
    schema = T.StructType(df.schema.fields + [T.StructField("_part", T.IntegerType()), T.StructField("_i", T.LongType())])

    def add(batches):
        part, done, last, held = TaskContext.get().partitionId(), 0, None, [0] * len(sums)
        for batch in filled(batches):
            n = batch.num_rows
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
            new = np.zeros(n, bool)
            new[0] = last != tuple(int(k[0]) for k in keys)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            run, made = np.cumsum(new), {}  # 0 for rows that go on with the last key of the batch before
            for j, name in enumerate(sums):
                total = np.cumsum(batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64))
                before = np.concatenate([[0], total])[np.flatnonzero(new)]
                total = total - np.concatenate([[-held[j]], before])[run]
                if modulus:
                    total %= modulus[j]
                made[name], held[j] = pa.array(total), int(total[-1])
            last = tuple(int(k[-1]) for k in keys)
            made |= {"_part": pa.array(np.full(n, part, np.int32)), "_i": pa.array(np.arange(done, done + n))}
            done += n
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name) for f in schema.fields], names=schema.names)

    n = partitions(df)
    ordered = df.repartitionByRange(n, *key, *order).sortWithinPartitions(*key, *order)
    local = saved(df.sparkSession, ordered.mapInArrow(add, schema), "running")
    ends = local.groupBy("_part").agg(F.min_by(F.struct(*key), "_i").alias("first"), F.max_by(F.struct(*key), "_i").alias("last"), F.max_by(F.struct(*sums), "_i").alias("sums"))
    carried, at, total = [], None, ()
    for r in sorted(ends.collect()):  # one row per partition
        if tuple(r["first"]) == at:
            carried.append((r["_part"], *at, *total))
        if tuple(r["last"]) == at:
            total = tuple(a + b for a, b in zip(total, r["sums"]))
        else:
            at, total = tuple(r["last"]), tuple(r["sums"])
        if modulus:
            total = tuple(t % m for t, m in zip(total, modulus))
    if not carried:
        return local.select(*df.columns)
    names = [f"_k{i}" for i in range(len(key))] + [f"_s{i}" for i in range(len(sums))]
    before = df.sparkSession.createDataFrame(carried, "_part int, " + ", ".join(f"{c} long" for c in names))
    same = F.lit(True)
    for i, k in enumerate(key):
        same &= F.col(k) == F.col(f"_k{i}")
    whole = {}
    for i, s in enumerate(sums):
        total = F.col(s) + F.when(same, F.col(f"_s{i}")).otherwise(0)
        whole[s] = total % modulus[i] if modulus else total
    return local.join(before, "_part", "left").withColumns(whole).select(*df.columns)
