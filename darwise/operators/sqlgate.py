"""Read-only gate for SQL written by somebody else."""

import threading
import uuid
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from darwise import values as V
from darwise.functions.stages import let
from darwise.functions.text import col, strip

# Spark lets a SELECT call Java code; a read-only gate must not.
_CODE_CALLS = ["reflect", "try_reflect", "java_method"]
_FORBIDDEN = r"(?i)\b(" + "|".join(V.FORBIDDEN_SQL_WORDS + _CODE_CALLS) + r")\b"
_LIMIT = r"(?i)\blimit\s+(\d+)"


class UnsafeSQL(ValueError):
    pass


class SQLResult(NamedTuple):
    sql: str  # what ran: the safe form; of a refused statement the statement itself
    columns: list[str]
    rows: list[tuple]
    error: str | None = None
    attempts: int = 1
    explanation: str = ""  # what the statement's author says of it


_FILES_OFF = threading.Lock()  # two threads must not undo each other's setting


def _capped(s: Column, max_rows: int) -> Column:
    """Every ``limit n`` of the statement cut to ``max_rows``."""
    marked = F.regexp_replace(s, _LIMIT, "LIMIT $1")
    parts = F.split(marked, r"(?=\bLIMIT \d)")
    head = r"\ALIMIT (\d+)"

    def cap(part):
        n = F.coalesce(F.regexp_extract(part, head, 1).try_cast("decimal(38,0)"), F.lit(max_rows))
        limit = F.concat(F.lit("LIMIT "), F.least(n, F.lit(max_rows)).cast("string"))
        return F.when(part.rlike(head), F.concat(limit, F.regexp_replace(part, head, ""))).otherwise(part)

    return F.array_join(F.transform(parts, cap), "")


def sql_verdict(sql, max_rows: int = 50) -> Column:
    """``struct<verdict, reason, safe_sql>`` of a statement.

    Forbidden words and semicolons count inside string literals too: the gate
    rather refuses a harmless statement.
    """

    def judge(s):
        reason = (
            F.when(s.contains(";"), V.SQL_TOO_MANY)
            .when(~s.rlike(r"(?i)\A(select|with)\b"), V.SQL_NOT_SELECT)
            .when(s.rlike(_FORBIDDEN), V.SQL_FORBIDDEN)
        )
        limited = F.when(s.rlike(r"(?i)\blimit\b"), _capped(s, max_rows)).otherwise(
            F.concat(s, F.lit(f" LIMIT {max_rows}"))
        )
        return F.struct(
            F.when(reason.isNull(), "safe").otherwise("unsafe").alias("verdict"),
            reason.alias("reason"),
            F.when(reason.isNull(), limited).alias("safe_sql"),
        )

    return let(strip(F.rtrim(strip(F.coalesce(col(sql), F.lit(""))), F.lit(";"))), judge)


def checked_sql(spark: SparkSession, sql: str, max_rows: int = 50) -> str:
    """The safe form of one statement, or ``UnsafeSQL``."""
    v = spark.createDataFrame([(sql,)], "sql string").select(sql_verdict("sql", max_rows).alias("v")).first()["v"]
    if v["verdict"] != "safe":
        raise UnsafeSQL(v["reason"])
    return v["safe_sql"]


def guarded_sql(spark: SparkSession, sql: str, max_rows: int = 50) -> DataFrame:
    """A checked statement over the registered views, never more than ``max_rows`` rows."""
    safe = checked_sql(spark, sql, max_rows)
    # Tables only: a statement may not name files.
    key = "spark.sql.runSQLOnFiles"
    with _FILES_OFF:
        before = spark.conf.get(key, "true")
        spark.conf.set(key, "false")
        try:
            return spark.sql(safe).limit(max_rows)
        finally:
            spark.conf.set(key, before)


def run_guarded(spark: SparkSession, sql: str, max_rows: int = 50, timeout_s: float = 5.0) -> SQLResult:
    """Rows of a checked statement; its jobs are interrupted after ``timeout_s``."""
    df, safe = guarded_sql(spark, sql, max_rows), checked_sql(spark, sql, max_rows)
    sc, interrupt = spark.sparkContext, "spark.job.interruptOnCancel"
    before = sc.getLocalProperty(interrupt)
    tag = f"guarded-{uuid.uuid4().hex}"
    # Context tags: a session's own tags are known to the thread that set them only.
    sc.addJobTag(tag)
    sc.setInterruptOnCancel(True)
    timer = threading.Timer(timeout_s, sc.cancelJobsWithTag, [tag])
    timer.start()
    try:
        rows = [tuple(r) for r in df.collect()]
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
        sc.setLocalProperty(interrupt, before)
    return SQLResult(safe, df.columns, rows)


def first_runnable(
    spark: SparkSession, statements: list[str | tuple[str, str]], max_rows: int = 50, timeout_s: float = 5.0, max_attempts: int = 2
) -> SQLResult:
    """Result of the first statement that passes and runs, or the last error and no rows.

    A statement may come with its author's explanation.
    """
    error, last, told, tried = None, "", "", 0
    for tried, statement in enumerate(statements[:max_attempts], 1):
        last, told = (statement, "") if isinstance(statement, str) else statement
        try:
            return run_guarded(spark, last, max_rows, timeout_s)._replace(attempts=tried, explanation=told)
        except (UnsafeSQL, PySparkException) as e:
            error = str(e)
        except Exception as e:  # a failed or interrupted job surfaces as a gateway error
            if "Py4J" not in type(e).__name__:
                raise
            error = str(e)
    return SQLResult(last, [], [], error, tried, told)
