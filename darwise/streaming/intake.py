"""Contracts read as they arrive.

Extraction is narrow and keeps no state, so the batch functions serve a stream
as they are; this only wires a folder to a table.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from darwise.operators.contracts import extract_contracts
from darwise.sources.files import file_name, split_by_length


def contract_stream(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """``(source, text)`` of contract files as they appear in a folder."""
    files = spark.readStream.option("pathGlobFilter", pattern).option("wholetext", True).format("text").load(path)
    return files.select(
        file_name("_metadata.file_path").alias("source"), F.regexp_replace("value", "\r\n?", "\n").alias("text")
    )


class Intake(NamedTuple):
    records: StreamingQuery
    rejected: StreamingQuery  # (source, text) too short to be a contract

    def awaitTermination(self, timeout: float | None = None) -> bool:
        return all([q.awaitTermination(timeout) is not False for q in self])


def load_contracts(contracts: DataFrame, out: str, checkpoint: str, rejected: str | None = None) -> Intake:
    """Append the records of all contracts that are there now; run again for newer ones.

    Texts too short to be contracts go to ``rejected`` (``<out>-rejected``).
    """
    accepted, short = split_by_length(contracts)

    def started(df: DataFrame, name: str, path: str) -> StreamingQuery:
        return df.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start(path)

    return Intake(started(extract_contracts(accepted), "records", out), started(short, "rejected", rejected or f"{out.rstrip('/')}-rejected"))
