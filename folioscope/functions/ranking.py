"""Places in a sorted order without sorting a whole group in one task.

Rows are dealt to ranges of (key, ties) by limits drawn from a sample of rows, so a key that many rows share is split too; a range's place in
the table is the sum of the sizes before it, and only within a range are rows numbered by a window. Limits change the work's
split, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows looked at to draw limits, at most, for each range.
SAMPLE = 40


def limits(df: DataFrame, keys: list[str], parts: int) -> list[tuple]:
    """Up to ``parts`` - 1 rising tuples of ``keys``, from the rows with the least hashes of all of them; nulls come first."""
    rows = df.select(*keys).orderBy(F.xxhash64(*keys)).limit(SAMPLE * parts).orderBy(*keys).collect()
    found = [tuple(r) for r in rows]
    return list(dict.fromkeys(found[len(found) * i // parts] for i in range(1, parts))) if found else []


def range_of(df: DataFrame, keys: list[str], bounds: list[tuple]) -> Column:
    """How many bounds are at or below the row's ``keys``, by binary search."""
    if not bounds:
        return F.lit(0)
    kinds = [df.schema[k].dataType for k in keys]
    # a null field sorts before any other: each is compared by whether it is there, then by its value
    row = F.struct(*[x for i, k in enumerate(keys) for x in (F.col(k).isNotNull().alias(f"n{i}"), F.col(k).alias(f"v{i}"))])
    bound = lambda b: F.struct(*[x for i, (v, t) in enumerate(zip(b, kinds)) for x in (F.lit(v is not None).alias(f"n{i}"), F.lit(v).cast(t).alias(f"v{i}"))])
    table, n = F.array(*[bound(b) for b in bounds]), len(bounds)

    def step(lo: Column, i: Column) -> Column:
        return F.when((lo + i <= n) & (row >= F.element_at(table, F.least(lo + i, F.lit(n)))), lo + i).otherwise(lo)

    return F.aggregate(F.array(*[F.lit(1 << b) for b in range(n.bit_length() - 1, -1, -1)]), F.lit(0), step)


def with_rank(df: DataFrame, within: list[str], key: str, ties: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the row's place, from 0, among rows of equal ``within`` by key, then ties. Null keys come first."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [key, *ties]
    cut = df.withColumn("_range", range_of(df, keys, limits(df, keys, parts)))
    sizes = cut.groupBy(*within, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*within, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(*within, "_range").orderBy(*keys))
    return cut.withColumn("_local", local).join(starts, [*within, "_range"]).withColumn(name, (F.col("_start") + F.col("_local") - 1).cast("long")).select(*df.columns, name)
