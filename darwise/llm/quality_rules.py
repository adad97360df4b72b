"""Operator 8, quality rules with adaptive thresholds.

Each rule looks at one ratio of a text. What is too high or too low is learnt
from the corpus: deciles and medians of the ratio per language and source, sketches built
by partial aggregation and merged, also into one per language and one of all
texts. The fewer texts a group has, the more its quantiles are drawn to those of
its language, and these to those of all; nothing switches at a size. Texts are
then joined with the bounds of their group and filtered.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from darwise.llm.exchange import saved
from darwise.llm.statistics import statistics
from darwise.llm.tables import with_columns
from darwise.llm.text import filled, slices

# Ratio of a text, which side is bad, what the ratio is a mean over, and how far one such thing may move it. A bound lies
# `REACH` times the way from the group's median to its outer decile beyond that decile, and as far again as chance may
# move a text of its length, as clean groups can be very even.
RULES = {
    "symbol_ratio": ("n_symbols / word_chars", "high", "word_chars", 1.0),
    "dup_line_ratio": ("n_dup_lines / n_lines", "high", "n_lines", 1.0),
    "repeat_ratio": ("n_repeat_words / n_words", "high", "n_words", 1.0),
    "word_length": ("word_chars / n_words", "both", "n_words", 8.0),
    "upper_ratio": ("n_upper / word_chars", "high", "word_chars", 1.0),
    "mark_ratio": ("n_marks / word_chars", "high", "word_chars", 1.0),
    # Words that are distinct become fewer as a text goes on: the power of its length that they grow by.
    "distinct_ratio": ("ln(n_distinct_words) / ln(n_words)", "low", "n_words", 0.5),
}
REACH = 3.0
QUANTILES = (0.1, 0.5, 0.9)
HALF, STEEP = 150.0, 6  # texts at which a group's own quantiles count by half, and how fast that grows: a text adds 1 % at most
SKETCH = 1000  # accuracy of the quantile sketches
BASE_WORDS, BASE_REPEAT = 10, 20
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct_words")
VERDICT = ("base_failed", "kept", "failed_rules")


def with_figures(docs: DataFrame) -> DataFrame:
    """``docs`` with the figures of its texts, but without the texts; a column named like a figure gives way."""
    bare = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    schema = with_columns(bare, *(T.StructField(n, T.LongType()) for n in FIGURES))

    def run(batches):
        for batch in filled(batches):
            made = {n: [] for n in FIGURES}
            for part in slices(batch.column("text")):
                found = statistics(part)
                for n in FIGURES:
                    made[n].append(pa.array(found[n].astype("int64")))
            arrays = [pa.concat_arrays(made[f.name]) if f.name in made else batch.column(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema)


def _ratio(rule: str) -> Column:
    above, below = RULES[rule][0].split(" / ")
    return F.try_divide(F.expr(above).cast("double"), F.expr(below))


def thresholds(figures: DataFrame, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Bounds of every rule per group: ``_level`` 0 for (lang, source), 1 for lang, 2 for all; nulls are a group."""
    own = figures.select(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(k) for k in keys), *(_ratio(r).alias(r) for r in RULES))
    sketches = [F.percentile_approx(r, F.array(*(F.lit(q) for q in QUANTILES)), SKETCH).alias(r) for r in RULES]
    grouped = own.rollup(*keys).agg(*sketches, F.count(F.lit(1)).alias("_n"), F.grouping_id(*keys).alias("_level"))
    return grouped.select(*keys, "_n", F.when(F.col("_level") == 3, 2).otherwise(F.col("_level")).cast("int").alias("_level"), *RULES)


def blended(bounds: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """The quantiles that hold for each (lang, source): its own, drawn to its language's, drawn to those of all.

    A group of ``n`` texts counts by ``1 / (1 + (HALF / n)^STEEP)``, so a verdict moves
    smoothly as it grows. Outer deciles of few texts are unsure: where a tenth is
    junk, chance puts them into it or not. A ratio that no text of a group has comes from above.
    """
    k0, k1 = keys

    def level(number: int, *kept: str) -> DataFrame:
        weight = 1 / (1 + F.pow(HALF / F.col("_n"), F.lit(STEEP)))
        return bounds.where(F.col("_level") == number).select(*kept, weight.alias(f"_w{number}"), F.struct(*RULES).alias(f"_q{number}"))

    def drawn(own: Column, weight: Column, above: Column) -> Column:
        mixed = F.zip_with(own, above, lambda a, b: weight * a + (1 - weight) * b)
        return F.coalesce(mixed, own, above)

    # One row per group; the row of all texts is a single one.
    met, every = level(0, k0, k1).join(level(1, k0), k0), level(2).first()
    of_all = {r: F.lit(list(every["_q2"][r] if every and every["_q2"][r] else [])).cast("array<double>") for r in RULES}
    above = {r: drawn(F.col("_q1")[r], F.col("_w1"), F.when(F.size(a) > 0, a)) for r, a in of_all.items()}
    return met.select(k0, k1, *(drawn(F.col("_q0")[r], F.col("_w0"), above[r]).alias(r) for r in RULES))


def judge(docs: DataFrame, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Add the figures, ``base_failed``, ``kept`` and ``failed_rules`` to ``docs`` (without its texts).

    ``base_failed``: fewer than 10 words, or over 20 of 100 words in repeated
    5-word windows. ``kept`` is false if base_failed or if a rule fails. Null
    texts have no words; null languages and sources are groups of their own;
    small groups lean on their language and on all texts (``blended``). Input
    columns named like an added one give way.
    """
    spark = docs.sparkSession
    figures = saved(spark, with_figures(docs), "figures")
    bounds = saved(spark, blended(saved(spark, thresholds(figures, keys), "thresholds"), keys), "bounds")
    at = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"_k{i}") for i, k in enumerate(keys)]
    of_group = bounds.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*RULES).alias("_bounds"))
    # One row per group; Spark broadcasts them if they are small.
    out = figures.withColumns({f"_k{i}": c for i, c in enumerate(at)}).join(of_group, ["_k0", "_k1"], "left")
    bound = F.col("_bounds")
    failed = []
    for rule, (_, side, count, step) in RULES.items():
        low, middle, high = (bound[rule][i] for i in range(3))
        value, chance = _ratio(rule), F.try_divide(F.lit(step), F.sqrt(count))
        over, under = value > high + REACH * (high - middle) + chance, value < low - REACH * (middle - low) - chance
        bad = over if side == "high" else under if side == "low" else over | under
        failed.append(F.when(bad, F.lit(rule)))
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))
    out = out.withColumns({"base_failed": base, "failed_rules": F.array_compact(F.array(*failed))})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.drop("_k0", "_k1", "_bounds")
