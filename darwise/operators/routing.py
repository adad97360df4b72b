"""Question triage: language, route, project; history of a conversation."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from darwise import values as V
from darwise.functions.text import col, detect_language


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words anywhere, word borders or not."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def route(question) -> Column:
    """``both``, ``inventory`` or ``docs``, by the hints in the question."""
    q = F.lower(col(question))
    inventory = contains_any(q, V.INVENTORY_HINTS_AR + V.INVENTORY_HINTS_EN)
    documents = contains_any(q, V.DOCUMENT_HINTS_AR + V.DOCUMENT_HINTS_EN)
    return F.when(inventory & documents, "both").when(inventory, "inventory").otherwise("docs")


def detect_project(question, patterns: dict[str, list[str]] | None = None) -> Column:
    """First project, in the order of the table, whose pattern the question holds."""
    q = F.lower(col(question))
    patterns = V.PROJECT_PATTERNS if patterns is None else patterns
    return F.coalesce(*[F.when(contains_any(q, words), F.lit(p)) for p, words in patterns.items()])


def triage(questions: DataFrame, text: str = "text", patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``lang``, ``route``, ``project_id`` and which of search and SQL a question needs."""
    return questions.withColumns(
        {"lang": detect_language(text), "route": route(text), "project_id": detect_project(text, patterns)}
    ).withColumns(
        {
            "needs_documents": F.col("route").isin("docs", "both"),
            "needs_inventory": F.col("route").isin("inventory", "both"),
        }
    )


def recent_turns(conversations: DataFrame, n: int = V.HISTORY_TURNS) -> DataFrame:
    """The last ``n`` turns of each conversation; each task sends at most ``n`` rows of one."""
    last = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return conversations.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n).drop("_r")
