"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks. Of a source with weight w (a fraction of all), block i may not be placed before slot
floor(i / w) nor after slot ceil((i + 1) / w) - 1; one block goes to each slot, the released one with the earliest
deadline first. All windows are kept, so after any number t of slots a source has had its share w * t
to within less than one block. When a source has no blocks left, the rest go on as a new phase with their weights
scaled up, and every document is placed exactly once.

Weights are whole shares of their sum, taken exactly as they are given, so windows are never rounded. The schedule is a table
of (source, block, slot) that one task streams out, holding a few numbers per source and at most ``PERIOD`` slots to repeat; rows
find their slots in it by a join. The driver holds nothing but the weights that the caller gives.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Documents in a block; slots that are kept to be repeated, at most; slots given out at a time.
BLOCK, PERIOD, CHUNK = 64, 1 << 20, 1 << 16

Weights = dict[str | None, float | int | Fraction]


def shares(weights: list[float | int | Fraction]) -> list[int]:
    """The weights as whole numbers in exactly the same ratios; a float counts as the decimal number that it prints as."""
    exact = [Fraction(str(w)) if isinstance(w, float) else Fraction(w) for w in weights]
    if any(x <= 0 for x in exact):
        raise ValueError("weights are positive")
    whole = math.lcm(*(x.denominator for x in exact))
    return [int(x * whole) for x in exact]


def tempered(rows: int) -> int:
    """The weight of a source that none is given for: the square root of its rows, so that small sources are read more often than their size."""
    return max(1, math.isqrt(rows))


def _slots(left: list[int], share: list[int]) -> Iterator[list[int] | tuple[list[int], int]]:
    """The source of each slot in turn, in lists, and in pairs of (list, how often it comes); uses up ``left``."""
    active = [s for s in range(len(left)) if left[s] > 0]
    while active:
        period = sum(share[s] for s in active)
        fresh = sorted((-(-period // share[s]), s, 0) for s in active)
        ready, waiting, t = list(fresh), [], 0
        out: list[int] = []
        over = False
        while not over:
            while waiting and waiting[0][0] <= t:
                _, s, i = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(i + 1) * period // share[s]), s, i))
            deadline, s, i = heapq.heappop(ready)
            if t >= deadline:
                raise AssertionError("a block missed its deadline")
            out.append(s)
            left[s] -= 1
            over = not left[s]
            t += 1
            heapq.heappush(waiting, ((i + 1) * period // share[s], s, i + 1))
            if t == period:  # all sources have had their shares: the next period is like this one
                if not over and len(out) == period:
                    again = min((left[k] - 1) // share[k] for k in active)
                    for k in active:
                        left[k] -= again * share[k]
                    yield out, again + 1
                else:
                    yield out
                ready, waiting, t, out = list(fresh), [], 0, []
            elif len(out) >= CHUNK and period > PERIOD:
                yield out
                out = []
        if out:
            yield out
        active = [s for s in active if left[s]]


def schedule(blocks: list[int], share: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(source, block) of each slot, in pieces of about ``CHUNK`` slots and more; sources are numbers from 0."""
    done = np.zeros(len(blocks), np.int64)

    def numbered(source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(source, kind="stable")
        of, n = np.unique(source, return_counts=True)
        block = np.empty(len(source), np.int64)
        block[order] = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(done[of], n)
        done[of] += n
        return source, block

    held: list[np.ndarray] = []
    for part in _slots(list(blocks), share):
        one, times = part if isinstance(part, tuple) else (part, 1)
        one = np.array(one, np.int64)
        step = max(1, CHUNK // len(one))
        for lo in range(0, times, step):
            held.append(np.tile(one, min(step, times - lo)))
            if sum(map(len, held)) >= CHUNK:
                yield numbered(np.concatenate(held))
                held = []
    if held:
        yield numbered(np.concatenate(held))


def _scheduled(sizes: DataFrame, kind: str, weights: Weights | None, block: int) -> DataFrame:
    """(source, block, slot, share) from (source, n): one task streams the schedule."""
    ddl = f"source {kind}, block long, slot long, share decimal(38,0)"
    schema = common.arrow_type(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = [], []
        for b in batches:
            names += b.column(0).to_pylist()
            rows += b.column(1).to_pylist()
        order = sorted(range(len(names)), key=lambda k: (names[k] is not None, names[k]))
        names, rows = [names[k] for k in order], [rows[k] for k in order]
        share = shares([tempered(n) if weights is None else weights.get(s, 1) for s, n in zip(names, rows)])
        values, given = pa.array(names, schema.field(0).type), pa.array(share, schema.field(3).type)
        slot = 0
        for source, number in schedule([-(-n // block) for n in rows], share):
            at = pa.array(source)
            yield pa.RecordBatch.from_arrays([values.take(at), pa.array(number), pa.array(np.arange(slot, slot + len(source))), given.take(at)], schema=schema)
            slot += len(source)

    return common.materialize(sizes.repartition(1).mapInArrow(common.lean(run), ddl), "schedule")


def mix(docs: DataFrame, source: str, order: list[str], weights: Weights | None = None, block: int = BLOCK) -> DataFrame:
    """Adds block, slot, place (in the block) and share (the source's weight) to every row; sort by slot and place for the mixture.

    Within a source rows go by ``order``, which should tell them apart; rows that tie in it, repeated ones too, take places of
    their own in any order. A null source is a source of its own, null keys come first. ``weights`` are for the sources named, others
    count 1; without any, a source's is ``tempered``. An empty table gives an empty one. Where ``docs`` has a column of an added
    one's name, underscores are put behind the added name.
    """
    common.ship(docs.sparkSession)
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    s = at[source]
    ranked = common.global_rank(plain, [at[c] for c in order], within=s, name="r").withColumn("k", F.expr(f"r div {block}"))
    slots = _scheduled(ranked.groupBy(s).agg(F.count("*").alias("n")), docs.schema[source].dataType.simpleString(), weights, block)
    if slots.count() <= common.BROADCAST_ROWS:  # a row per block
        slots = F.broadcast(slots)
    placed = ranked.join(slots, F.col(s).eqNullSafe(F.col("source")) & (F.col("k") == F.col("block")))
    added = {"block": F.col("k"), "slot": F.col("slot"), "place": F.col("r") % block, "share": F.col("share")}
    return placed.select(*[F.col(at[c]).alias(c) for c in names], *[v.cast(v_type).alias(common.free_name(n, names)) for (n, v), v_type in zip(added.items(), ("long", "long", "long", "decimal(38,0)"))])


def mixed_order(docs: DataFrame, source: str, key: str, text: str, weights: Weights | None = None) -> DataFrame:
    """The rows of ``docs`` in the mixture's order: partition by partition, and within each. Cases as in ``mix``."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    col = {c: f"c{i}" for i, c in enumerate(names)}
    marked = mix(plain.withColumn("th", F.xxhash64(col[text])), col[source], [col[key], "th"], weights)
    ordered = marked.repartitionByRange(common.shuffle_partitions(docs.sparkSession), "slot", "place").sortWithinPartitions("slot", "place")
    return ordered.select(*[F.col(col[c]).alias(c) for c in names])


def op6_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with their slots; a source's weight (``share``) is the square root of its rows."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("th"))
    out = mix(docs, "source", ["doc_id", "th"])
    return out.select("doc_id", "source", "block", "slot", "place", F.col("share").cast("long").alias("share"))


#: A slot at a time: of the released blocks, that of the earliest deadline; a new phase begins when a source ends.
OP6_SQL = f"""
WITH RECURSIVE n AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), o AS (
  SELECT source, CAST(row_number() OVER (ORDER BY source NULLS FIRST) AS BIGINT) AS s, CAST((n + {BLOCK - 1}) // {BLOCK} AS BIGINT) AS blocks, CAST(greatest(1, floor(sqrt(n))) AS BIGINT) AS share FROM n
), a AS (
  SELECT list(blocks ORDER BY s) AS blocks, list(share ORDER BY s) AS share, list(CAST(0 AS BIGINT) ORDER BY s) AS none FROM o
), e AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS t, blocks AS rest, none AS had, share, none, CAST(NULL AS BIGINT) AS s FROM a
  UNION ALL
  SELECT slot + 1, CASE WHEN rest[pick] = 1 THEN 0 ELSE t + 1 END,
    list_transform(rest, lambda x, i: CASE WHEN i = pick THEN x - 1 ELSE x END),
    CASE WHEN rest[pick] = 1 THEN none ELSE list_transform(had, lambda x, i: CASE WHEN i = pick THEN x + 1 ELSE x END) END, share, none, pick
  FROM (
    SELECT *, list_min(list_transform(list_filter(range(1, len(rest) + 1), lambda i: rest[i] > 0 AND had[i] * period // share[i] <= t),
      lambda i: {{'d': ((had[i] + 1) * period + share[i] - 1) // share[i], 's': i}})).s AS pick
    FROM (SELECT *, list_sum(list_transform(share, lambda x, i: CASE WHEN rest[i] > 0 THEN x ELSE 0 END)) AS period FROM e WHERE list_sum(rest) > 0)
  )
), slots AS (
  SELECT source, slot, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS block, o.share FROM e JOIN o USING (s) WHERE slot >= 0
), d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS k FROM documents
)
SELECT doc_id, d.source AS source, block, slot, k % {BLOCK} AS place, share FROM d JOIN slots ON d.source IS NOT DISTINCT FROM slots.source AND k // {BLOCK} = block
"""
