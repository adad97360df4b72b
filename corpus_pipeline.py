"""A training corpus from the table of documents, stage by stage.

Every stage takes ``(spark, docs, sf_dir)``; what it returns is written as
Parquet and read again as the documents of the next. All but the last keep the
columns of ``documents`` (extra columns stay as they are). An empty table passes
every stage; null and empty texts, and null or repeated doc_ids, are treated as
the operators in ``darwise/llm`` say.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from darwise.llm.decontaminate import decontaminate
from darwise.llm.exchange import saved
from darwise.llm.packing import pack
from darwise.llm.quality_model import classify, fit, with_figures
from darwise.llm.queries import remainder, table, vocabulary
from darwise.llm.simhash import near_duplicates
from darwise.llm.substrings import dedup_substrings
from darwise.llm.tables import prepare, texts


def sealed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and everything else as ``_docs``, where no column of an operator can clash with it."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_docs"))


def unsealed(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*(F.col("text") if c == "text" else F.col(f"_docs.`{c}`").alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; rows of one doc_id are judged one by one."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels").where(remainder(3) != 1)
    model = fit(saved(spark, with_figures(texts(docs)), "figures"), labels)
    # The figures are made again beside the texts, so that no text is shuffled.
    judged = classify(sealed(docs), model)
    return unsealed(judged.where("predicted = 1"), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document of smallest doc_id stays; groups that share a doc_id keep one each.

    Rows without a doc_id go if their group has a document with one; else those
    of equal text stay once.
    """
    prepare(spark)
    # Rows are found again by doc_id and text, as a doc_id may stand on several texts.
    key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    found = near_duplicates(texts(docs).withColumn("_key", key), root="_root")
    least = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = least.where("doc_id is not null").groupBy("_root").agg(F.min("doc_id").alias("_first"), F.min("_key").alias("_text")).select("_first", "_text")
    first = saved(spark, one.unionByName(least.where("doc_id is null").select(F.col("doc_id").alias("_first"), F.col("_key").alias("_text")).distinct()), "first")
    own = sealed(docs).withColumn("_key", key)
    named = own.join(first.where("_first is not null"), (F.col("doc_id") == F.col("_first")) & (F.col("_key") == F.col("_text")), "left_semi").dropDuplicates(["doc_id", "_key"])
    nameless = own.where("doc_id is null").join(first.where("_first is null"), F.col("_key") == F.col("_text"), "left_semi").dropDuplicates(["_key"])
    return unsealed(named.unionByName(nameless), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of 20 words lose their words; a text that loses none stays as it was. ``n_chars`` is renewed."""
    prepare(spark)
    out = dedup_substrings(sealed(docs))
    out = unsealed(out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    prepare(spark)
    judged = decontaminate(sealed(docs), table(spark, sf_dir, "benchmark"))
    return unsealed(judged.where("not contaminated"), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, in sequences of at most 2048 tokens."""
    prepare(spark)
    return pack(docs, vocabulary(), end_id=0, capacity=2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Models, fingerprints and tokens are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(spark, stage(spark, docs, sf_dir), name)
    return docs
