"""What to try when a search finds nothing: titles that share words with the query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .search import parse_query


def suggest(entries: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(full_path, title, shared): entries whose titles have most of the query's words, ties by path."""
    q = parse_query(query)
    wanted = F.array(*[F.lit(t) for t in sorted({*q.terms, *q.required})]).cast("array<string>")
    shared = F.size(F.array_intersect(F.array_distinct(tokens(F.col("title"))), wanted)).cast("long")
    return entries.withColumn("shared", shared).where("shared > 0").select("full_path", "title", "shared").orderBy(F.desc("shared"), "full_path").limit(limit)


def token_counts(entries: DataFrame, column: str = "title") -> DataFrame:
    """(token, entries, uses)."""
    each = entries.select("full_path", F.explode(tokens(F.col(column))).alias("token"))
    return each.groupBy("token").agg(F.countDistinct("full_path").alias("entries"), F.count("*").alias("uses"))
