"""The search grammar for SQL users: ``SELECT * FROM query_words('site:x +y z')``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class QueryWords:
    """(kind, value) of each word of a search query, in order of kinds."""

    def eval(self, query: str) -> Iterator[tuple[str, str]]:
        from folioscope.operators.search import parse_query

        q = parse_query(query)
        for kind in ("sites", "namespaces", "required", "terms"):
            for value in getattr(q, kind):
                yield kind, value


def register(spark: SparkSession) -> None:
    """Makes ``query_words`` known to the session's SQL."""
    from ..session import ship

    ship(spark)
    spark.udtf.register("query_words", udtf(QueryWords, returnType="kind string, value string"))
