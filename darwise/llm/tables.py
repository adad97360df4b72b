"""Frames for the operators: clashing column names, row keys, settings."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text``, whatever else the table has."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def with_columns(schema: T.StructType, *added: T.StructField) -> T.StructType:
    """``schema`` with the added columns; a column of the same name (in any case) gives way."""
    names = {f.name.lower() for f in added}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + list(added))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def prepare(spark: SparkSession) -> SparkSession:
    """Session setting the operators are written for: texts reach Python workers a few MB at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark
