"""Keyword search over entries.

A query is words: ``site:host``, ``namespace:name``, ``keyword`` and ``+keyword``. Hosts match themselves and their
subdomains; several hosts (or namespaces) are alternatives. Keywords match titles and URLs loosely, in any case.
Every + keyword must match; if there is none, one plain keyword must. A match in the title counts 2, in the URL 1. Words
with other prefixes are plain keywords; a query without words finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import holds, host


@dataclass(frozen=True)
class Query:
    terms: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    sites: tuple[str, ...] = ()
    namespaces: tuple[str, ...] = ()

    @property
    def empty(self) -> bool:
        return not (self.terms or self.required or self.sites or self.namespaces)


def parse_query(text: str | None) -> Query:
    """A query from what a user types; prefixes and + without anything behind them are ignored."""
    kinds: dict[str, list[str]] = {"terms": [], "required": [], "sites": [], "namespaces": []}
    for word in (text or "").split():
        for prefix, kind in (("site:", "sites"), ("namespace:", "namespaces"), ("+", "required"), ("", "terms")):
            if word.lower().startswith(prefix):
                value = word[len(prefix) :].lower() if kind != "namespaces" else word[len(prefix) :]
                if value and value not in kinds[kind]:
                    kinds[kind].append(value)
                break
    return Query(**{k: tuple(v) for k, v in kinds.items()})


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def matches(term: str) -> Column:
    return holds(F.col("title"), term) | holds(F.col("path"), term)


def predicate(q: Query) -> Column:
    """Which entries a query finds."""
    if q.empty:
        return F.lit(False)
    found = F.lit(True)
    if q.sites:
        h = host(F.col("path"))
        found = found & _any([(h == s) | F.endswith(h, F.lit("." + s)) for s in q.sites])
    if q.namespaces:
        found = found & F.col("namespace").isin(list(q.namespaces))
    for t in q.required:
        found = found & matches(t)
    if q.terms and not q.required:
        found = found & _any([matches(t) for t in q.terms])
    return found


def score(q: Query) -> Column:
    """Whole points, so that ties are exact."""
    total = F.lit(0)
    for t in (*q.terms, *q.required):
        total = total + F.when(holds(F.col("title"), t), 2).otherwise(0) + F.when(holds(F.col("path"), t), 1).otherwise(0)
    return total.cast("long")


def search(entries: DataFrame, query: str | Query, limit: int | None = 20) -> DataFrame:
    """The best entries: by score, then full path and archive."""
    q = parse_query(query) if isinstance(query, str) else query
    found = entries.where(predicate(q)).withColumn("score", score(q))
    return found.orderBy(F.desc("score"), "full_path", "archive").limit(limit) if limit else found


def boosted(found: DataFrame, bookmarks: DataFrame, limit: int | None = 20) -> DataFrame:
    """Search results with votes, bookmarked ones on top. Bookmarks: (archive, full_path, votes), one row each."""
    out = found.join(bookmarks.select("archive", "full_path", "votes"), ["archive", "full_path"], "left")
    return out.orderBy(F.desc_nulls_last("votes"), F.desc("score"), "full_path", "archive").limit(limit) if limit else out


def vote(bookmarks: DataFrame, clicks: DataFrame) -> DataFrame:
    """Bookmarks after more votes: (archive, full_path, votes, updated)."""
    return bookmarks.unionByName(clicks).groupBy("archive", "full_path").agg(F.sum("votes").alias("votes"), F.max("updated").alias("updated"))
