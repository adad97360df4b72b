"""Search index as Parquet tables, in segments: build, add, remove, load with checks.

A segment holds some chunks with their numbers, terms, postings and vectors, and
its share of the statistics. Adding chunks writes a segment; removing some
writes their numbers and what they took part in the statistics with. Nothing
that was written is written again, and scores are those of an index built anew.
One pointer row, written last, names the segments that hold; a change that
breaks off leaves the index before it as it was.
"""

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from darwise import values as V
from darwise.operators.bm25 import BLOCK_BITS, LexicalIndex, index_terms, index_totals, postings_of, store_postings, term_statistics
from darwise.operators.vectors import hashed_ngrams

HASHED = "hashed-ngrams"
META = "version string, segments array<string>, removals array<string>, embedder string, dim int, n long, next_doc long, built_at timestamp"


class SearchIndex(NamedTuple):
    chunks: DataFrame
    lexical: LexicalIndex
    vectors: DataFrame
    embedder: str
    dim: int


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _publish(spark: SparkSession, path: str, segments: list[str], removals: list[str], embedder: str, dim: int, n: int, next_doc: int) -> None:
    row = [(uuid.uuid4().hex, segments, removals, embedder, dim, n, next_doc)]
    pointer = spark.createDataFrame(row, META.rpartition(",")[0]).withColumn("built_at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/index_meta")


def _write_segment(chunks: DataFrame, path: str, first_doc: int, dim: int, vectors: DataFrame | None) -> tuple[str, int, int]:
    """Name, number of chunks and next free number of a new segment, checked but not yet published."""
    name = f"segment-{uuid.uuid4().hex}"
    at = f"{path}/{name}"
    plain = chunks.drop("doc")
    stored = _kept(plain.select((F.monotonically_increasing_id() + first_doc).alias("doc"), "*"), f"{at}/chunks")
    n, distinct, last = stored.agg(F.count(F.lit(1)), F.count_distinct("chunk_id"), F.max("doc")).first()
    if n == 0:
        raise ValueError("no chunks to index")
    if n != distinct:
        raise ValueError("chunk ids are repeated")
    terms = _kept(index_terms(stored), f"{at}/terms")
    store_postings(postings_of(terms), f"{at}/postings")
    _kept(term_statistics(terms), f"{at}/term_stats")
    _kept(terms.agg(F.count(F.lit(1)).alias("n"), F.sum("len").cast("long").alias("tokens")), f"{at}/size")
    if vectors is None:
        vectors = hashed_ngrams(stored.select("chunk_id", "text"), dim=dim)
    numbered = vectors.select("chunk_id", "vector").join(stored.select("doc", "chunk_id"), "chunk_id", "left")
    held = _kept(numbered, f"{at}/vectors")
    missing = stored.join(held, "doc", "left_anti").limit(1).count()
    if held.count() != n or missing or held.where("doc is null").limit(1).count():
        raise ValueError("chunks and vectors differ")
    # A posting row covers numbers of one segment only.
    return name, n, ((last >> BLOCK_BITS) + 1) << BLOCK_BITS


def build_index(chunks: DataFrame, path: str, embedder: str = HASHED, dim: int = V.VECTOR_DIM, vectors: DataFrame | None = None) -> None:
    """Write an index of one segment, check it and point to it.

    No chunks, a repeated chunk_id, or vectors for other chunks are errors.
    """
    name, n, next_doc = _write_segment(chunks, path, 0, dim, vectors)
    _publish(chunks.sparkSession, path, [name], [], embedder, dim, n, next_doc)


def _meta(spark: SparkSession, path: str):
    return spark.read.schema(META).parquet(f"{path}/index_meta").orderBy(F.desc("built_at")).first()


def add_chunks(chunks: DataFrame, path: str, vectors: DataFrame | None = None) -> None:
    """Add chunks as a segment. Ids that the index holds are an error; ids that were removed may come again."""
    spark = chunks.sparkSession
    meta = _meta(spark, path)
    held = _living(spark, path, meta, "chunks").select("chunk_id")
    if chunks.join(held, "chunk_id", "left_semi").limit(1).count():
        raise ValueError("chunks are in the index already; remove them first")
    name, n, next_doc = _write_segment(chunks, path, meta["next_doc"], meta["dim"], vectors)
    _publish(spark, path, [*meta["segments"], name], meta["removals"], meta["embedder"], meta["dim"], meta["n"] + n, next_doc)


def remove_chunks(ids: DataFrame, path: str) -> int:
    """Take the chunks of ``ids(chunk_id)`` out; returns how many the index held. The last ones cannot go."""
    spark = ids.sparkSession
    meta = _meta(spark, path)
    terms = _living(spark, path, meta, "terms").join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    name = f"removal-{uuid.uuid4().hex}"
    gone = _kept(terms.select("doc", "chunk_id", "len", "postings"), f"{path}/{name}/terms")
    n = gone.count()
    if n == 0:
        return 0
    if n == meta["n"]:
        raise ValueError("no chunks would be left")
    _kept(term_statistics(gone).withColumn("df", -F.col("df")), f"{path}/{name}/term_stats")
    _kept(gone.agg((-F.count(F.lit(1))).alias("n"), (-F.sum("len")).cast("long").alias("tokens")), f"{path}/{name}/size")
    _publish(spark, path, meta["segments"], [*meta["removals"], name], meta["embedder"], meta["dim"], meta["n"] - n, meta["next_doc"])
    return n


def _table(spark: SparkSession, path: str, parts: list[str], name: str) -> DataFrame:
    """A table of all segments, or of all removals, read as one."""
    read = [spark.read.parquet(f"{path}/{p}/{name}") for p in parts]
    out = read[0]
    for more in read[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def _living(spark: SparkSession, path: str, meta, name: str) -> DataFrame:
    rows = _table(spark, path, meta["segments"], name)
    return rows.join(_table(spark, path, meta["removals"], "terms").select("doc"), "doc", "left_anti") if meta["removals"] else rows


def load_index(spark: SparkSession, path: str, embedder: str = HASHED, dim: int | None = None) -> SearchIndex:
    """The index as it was published last; another embedder or dimension, or tables of other sizes than noted, are refused."""
    meta = _meta(spark, path)
    if meta["embedder"] != embedder:
        raise ValueError(f"index was built with {meta['embedder']!r}, not {embedder!r}; build it again")
    if dim is not None and meta["dim"] != dim:
        raise ValueError(f"index was built with {meta['dim']} dimensions, not {dim}; build it again")
    chunks, vectors, terms = (_living(spark, path, meta, name) for name in ("chunks", "vectors", "terms"))
    if {chunks.count(), vectors.count()} != {meta["n"]}:
        raise ValueError("index tables differ in number from what was built; build it again")
    parts = meta["segments"] + meta["removals"]
    # Largest counts and smallest lengths may be those of removed chunks; as bounds they hold.
    stats = _table(spark, path, parts, "term_stats")
    if len(parts) > 1:
        stats = stats.groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len")).where("df > 0")
    size = _table(spark, path, parts, "size").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).first()
    totals = index_totals(stats, size["n"], size["tokens"] / size["n"])
    removed = _table(spark, path, meta["removals"], "terms").select("doc") if meta["removals"] else None
    lexical = LexicalIndex(terms, _table(spark, path, meta["segments"], "postings"), stats, totals, removed)
    return SearchIndex(chunks.drop("doc"), lexical, vectors.drop("doc"), meta["embedder"], meta["dim"])


def load_or_build(chunks: DataFrame, path: str, embedder: str = HASHED, dim: int = V.VECTOR_DIM) -> SearchIndex:
    spark = chunks.sparkSession
    try:
        return load_index(spark, path, embedder, dim)
    except (AnalysisException, ValueError):
        build_index(chunks, path, embedder, dim)
        return load_index(spark, path, embedder, dim)
