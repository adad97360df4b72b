"""Ways to keep long Column pipelines linear in size.

The optimizer copies an expression into every filter and projection that uses
it. For a few regular expressions that is right; for records built of dozens of
them the copies multiply. These two helpers mark the places where a value is to
be computed once.
"""

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add ``columns`` as values: a one-row ``inline`` that nothing is pushed through."""
    keep = df.columns if keep is None else keep
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*[F.col(c) for c in keep if c not in columns], F.inline(F.array(row)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run_counts(values: Column, value: str, count: str) -> Column:
    """Distinct entries of an array with their counts, by sorting within the row."""

    def runs(s):
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        starts = F.when(F.size(s) > 0, starts).otherwise(F.array().cast("array<int>"))

        def counted(b):
            nxt = lambda k: F.coalesce(F.get(b, k + 1), F.size(s) + 1)
            return F.transform(b, lambda i, k: F.struct(F.get(s, i - 1).alias(value), (nxt(k) - i).alias(count)))

        return let(starts, counted)

    return let(F.sort_array(values), runs)
