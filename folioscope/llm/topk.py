"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of ``SLICES`` partial scores, one per slice of the dimensions. Phase 1 gathers local lists: of each block of
candidates, those best for a query by the first slice alone, with their exact scores. The k-th best of these is a safe cutoff: no
query's true k-th score is lower than the best of them over the blocks. Phase 2 hands the cutoffs to every block. Phase 3
collects what may suffice: an entry reaches the cutoff only if, in some slice, it reaches cutoff / SLICES, so candidates whose
length in every slice is too short for that are left out before anything is multiplied. The others are summed slice by slice,
and after each slice candidates go for which what is missing, bounded by the lengths of the rest, reaches no query's cutoff. What
remains after the last slice has its exact score.

On vectors without any structure the bounds leave out little, and each pair of a query and a candidate is multiplied once and a
quarter. Vectors travel in blocks of fixed size. Each task holds some blocks of candidates and reads all blocks of queries, one
after the other, from the shared folder, so queries are neither shuffled nor broadcast, however many tasks there are; nothing is
sent to the driver and no list is longer than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import file_system

from . import common

SLICES, LOWEST = 4, -(2**63)
#: Queries that are compared with a block of candidates at a time; candidates that are tried before all are held against a bound.
STEP, PROBE = 256, 128
#: Length of local lists, in times k: what is best by one slice alone need not be best.
LISTED = 16
#: A task holds candidates of so many bytes (a block at least), and reads the queries once for each such hold.
HELD = 32 << 20
BLOCK = "block long, n int, dim int, kind string, ids binary, rows binary, data binary"


def grid_vectors(df: DataFrame, key: str, vector: str, scale: int = 64) -> DataFrame:
    """(id, row, v): floor(scale * x) of every component, as long.

    Rows with a null key or vector, or a null, NaN or infinite component, take no part. Rows that repeat a key all stay; ``row``
    tells them apart once the table is staged. An empty vector is kept: it is zero everywhere.
    """
    bad: Column = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    plain = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(~bad)
    return plain.select(F.col(key).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), v.alias("v"))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Packs (id, row, v) into rows of up to ``rows`` vectors: ids, and a matrix in the narrowest integers that hold it.

    In a block alike vectors lie together: they go by their largest component and its sign, then by that component.
    """
    schema = common.arrow_type(BLOCK)

    def pack(ids: list, own: list, vs: list, number: int) -> pa.RecordBatch:
        dim = max(map(len, vs))
        m = np.zeros((len(vs), dim), np.int64)
        for i, v in enumerate(vs):  # shorter vectors end in zeros
            m[i, : len(v)] = v
        if dim:
            top = np.abs(m.astype(np.float64)).argmax(1)
            most = m[np.arange(len(m)), top]
            order = np.lexsort((most, top))
            m, ids, own = m[order], [ids[i] for i in order], [own[i] for i in order]
        kind = next(k for k in ("i1", "i2", "i4", "i8") if m.size == 0 or (np.iinfo(k).min <= m.min() and m.max() <= np.iinfo(k).max))
        block = TaskContext.get().partitionId() << 33 | number
        row = {"block": [block], "n": [len(vs)], "dim": [dim], "kind": [kind], "ids": [np.array(ids, "i8").tobytes()], "rows": [np.array(own, "i8").tobytes()], "data": [m.astype(kind).tobytes()]}
        return common.to_batch(row, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, vs, number = [], [], [], 0
        for b in batches:
            values = b.column(2)
            flat, ends = values.flatten().to_numpy(), np.asarray(values.offsets)
            ids += b.column(0).to_pylist()
            own += b.column(1).to_pylist()
            vs += [flat[s:e] for s, e in zip(ends[:-1] - ends[0], ends[1:] - ends[0])]
            while len(ids) >= rows:
                yield pack(ids[:rows], own[:rows], vs[:rows], number)
                ids, own, vs, number = ids[rows:], own[rows:], vs[rows:], number + 1
        if ids:
            yield pack(ids, own, vs, number)

    return vectors.select("id", "row", "v").mapInArrow(run, BLOCK)


def _matrix(n: int, dim: int, kind: str, data: bytes, width: int) -> np.ndarray:
    m = np.frombuffer(data, kind).reshape(n, dim)
    return np.pad(m, ((0, 0), (0, width - dim))) if dim < width else m


def exact_type(q: np.ndarray, c: np.ndarray) -> type:
    """The fastest type that holds every sum of products of the two exactly; whole numbers wrap beyond 64 bits."""
    top = int(np.abs(q.astype(np.float64)).max(initial=0)) * int(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64


def slices(width: int) -> list[slice]:
    """The slices of the dimensions, of nearly equal width."""
    ends = [width * s // SLICES for s in range(SLICES + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:]) if b > a]


def lengths(m: np.ndarray) -> np.ndarray:
    """(slice, row): the length of each row in each slice, rounded up."""
    x = m.astype(np.float64)
    return np.array([np.sqrt((x[:, s] ** 2).sum(1)) * (1 + 1e-9) for s in slices(m.shape[1])]).reshape(-1, len(m))


def gather(q: np.ndarray, c: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray | None:
    """Phase 1: per query the k-th best exact score among its ``LISTED`` * k best candidates by the first slice; None if there are no k others."""
    n = len(c) - 1
    if n < k:
        return None
    kind = exact_type(q, c)
    a, b = q.astype(kind), c.astype(kind)
    first = (slices(q.shape[1]) or [slice(0, 0)])[0]
    local = a[:, first] @ b[:, first].T
    local[own] = np.iinfo(kind).min if kind is np.int64 else -np.inf
    width = min(n, LISTED * k)
    chosen = np.argpartition(local, len(c) - width, axis=1)[:, len(c) - width :]
    score = np.stack([b[at] @ x for at, x in zip(chosen, a)]) if len(a) else np.zeros((0, width), kind)
    return np.partition(score, width - k, axis=1)[:, width - k].astype(np.int64)


def resolve(q: np.ndarray, c: np.ndarray, own: tuple[np.ndarray, np.ndarray], cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Phases 2 and 3: (query, candidate, score) of all entries that reach their query's cutoff, and how many scores' worth of products
    that took, a few probes aside."""
    kind = exact_type(q, c)
    rows, parts, done = np.arange(len(c)), slices(q.shape[1]), 0
    a, b = q.astype(kind), c.astype(kind)
    limit = cut.astype(np.float64)
    pruned = kind is not np.int64  # sums that wrap obey no bound
    if pruned and len(parts) and len(c):
        lq, lc = lengths(q), lengths(c)
        # the uniform threshold: a score of at least limit needs a partial score of at least limit / slices somewhere
        local = np.zeros(len(c), bool)
        for s in range(len(parts)):
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(limit <= 0, -np.inf, np.where(lq[s] > 0, limit / len(parts) / lq[s], np.inf)).min()
            local |= lc[s] >= least
        rows = np.flatnonzero(local)
        rest_q, rest_c = (np.sqrt(np.cumsum((x**2)[::-1], axis=0)[::-1]) * (1 + 1e-9) for x in (lq, lc))
    if len(rows) < len(c):
        b = b[rows]
    total = np.zeros((len(q), len(rows)), kind)

    def reach(total: np.ndarray, s: int, at: np.ndarray) -> np.ndarray:
        """Which candidates may still reach some query's cutoff, from slice s on."""
        rest = rest_q[s][:, None].astype(np.float32) * (rest_c[s][at].astype(np.float32) * np.float32(1 + 1e-5))
        return (total + rest >= limit[:, None]).any(0)

    ends = [part.stop for part in parts]
    if pruned and total.size:  # a few candidates tell after which slices looking at all of them may pay
        few = np.arange(0, len(rows), -(-len(rows) // PROBE))
        ends = [e for s, e in enumerate(ends, 1) if s == len(ends) or reach(a[:, :e] @ b[few, :e].T, s, rows[few]).mean() < 0.8]
    at = 0
    for e in ends:
        total += a[:, at:e] @ b[:, at:e].T
        done += total.size * (e - at)
        at = e
        if pruned and e < ends[-1]:
            open_ = reach(total, [p.stop for p in parts].index(e) + 1, rows)
            rows, b, total = rows[open_], b[open_], total[:, open_]
    over = total >= cut[:, None]
    if len(own[0]) and len(rows):
        at = np.minimum(np.searchsorted(rows, own[1]), len(rows) - 1)
        there = rows[at] == own[1]
        over[own[0][there], at[there]] = False
    at_q, at_c = np.nonzero(over)
    return at_q, rows[at_c], total[at_q, at_c].astype(np.int64), done / max(1, q.shape[1])


def _own(qi: np.ndarray, ci: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a query's own row among the candidates."""
    order = np.argsort(ci)
    at = np.searchsorted(ci, qi, sorter=order)
    rows = np.flatnonzero((at < len(ci)) & (ci[order[np.minimum(at, len(ci) - 1)]] == qi))
    return rows, order[at[rows]]


def _held(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[list[dict]]:
    """Candidate blocks, in lists of up to ``most`` bytes of vectors."""
    held, size = [], 0
    for b in batches:
        for i in range(b.num_rows):
            r = {k: v[0] for k, v in b.slice(i, 1).to_pydict().items()}
            if held and size + len(r["data"]) > most:
                yield held
                held, size = [], 0
            held.append(r)
            size += len(r["data"])
    if held:
        yield held


def _read(uri: str) -> Iterator[tuple[dict, np.ndarray]]:
    """(row, cutoffs) of each staged block of queries, a few rows at a time; cutoffs are the lowest where the table has none."""
    system, at = file_system(uri)
    for x in sorted(system.get_file_info(fs.FileSelector(at)), key=lambda x: x.path):
        if not x.base_name.endswith(".parquet"):
            continue
        with system.open_input_file(x.path) as f:
            for b in pq.ParquetFile(f).iter_batches(batch_size=8, use_threads=False):
                plain = b.select([c for c in b.schema.names if c != "cutoffs"]).to_pylist()
                for i, r in enumerate(plain):
                    cut = np.full(r["n"], LOWEST, np.int64)
                    if "cutoffs" in b.schema.names and b.column("cutoffs")[i].is_valid:
                        listed = b.column("cutoffs")[i].values
                        cut[listed.field("i").to_numpy()] = listed.field("cutoff").to_numpy()
                    yield r, cut


def _meet(q: dict, c: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """(first query, queries, candidates, places of own rows) for pieces of a pair of blocks."""
    width = max(q["dim"], c["dim"])
    qm, cm = (_matrix(x["n"], x["dim"], x["kind"], x["data"], width) for x in (q, c))
    qr, cr = (np.frombuffer(x["rows"], "i8") for x in (q, c))
    for lo in range(0, len(qm), STEP):
        yield lo, qm[lo : lo + STEP], cm, _own(qr[lo : lo + STEP], cr)


def _gather(k: int, uri: str):
    """Phase 1 in the blocks of a task."""
    schema = common.arrow_type("q_block long, i int, cutoff long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            for r, best in _read(uri):
                any_ = False
                for c in held:
                    for lo, q, cm, own in _meet(r, c):
                        cut = gather(q, cm, own, k)
                        if cut is not None:
                            any_ = True
                            best[lo : lo + len(q)] = np.maximum(best[lo : lo + len(q)], cut)
                if any_:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(r["n"], r["block"])), pa.array(np.arange(r["n"], dtype=np.int32)), pa.array(best)], schema=schema)

    return run


FOUND = "query_id long, query_row long, vec_id long, score long"


def _resolve(k: int, uri: str):
    """Phases 2 and 3 in a block, and the block's k best."""
    schema = common.arrow_type(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            for r, cut in _read(uri):
                qi, qr = (np.frombuffer(r[x], "i8") for x in ("ids", "rows"))
                for c in held:
                    ci = np.frombuffer(c["ids"], "i8")
                    for lo, q, cm, own in _meet(r, c):
                        at_q, at_c, score, _ = resolve(q, cm, own, cut[lo : lo + len(q)])
                        ids = ci[at_c]
                        order = np.lexsort((ids, -score.astype(object) if len(score) and score.min() == LOWEST else -score, at_q))
                        at_q = at_q[order]
                        first = np.searchsorted(at_q, np.arange(len(q)))
                        keep = np.arange(len(at_q)) - first[at_q] < k
                        order, at_q = order[keep], at_q[keep] + lo
                        yield pa.RecordBatch.from_arrays([pa.array(qi[at_q]), pa.array(qr[at_q]), pa.array(ids[order]), pa.array(score[order])], schema=schema)

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int, query_block: int = 2048, candidate_block: int = 8192, slots: int | None = None) -> DataFrame:
    """(query_id, query_row, rank, vec_id, score): the k best candidates of every query (all, if fewer), ties to the smaller id.

    Both inputs are (id, row, v) as from ``grid_vectors``, of one staged table; a candidate with the query's row is its own and left
    out, others with its id are not. Scores are exact while they fit in 64 bits and wrap beyond. No queries or no candidates: no rows.
    """
    spark = candidates.sparkSession
    common.ship(spark)
    slots = slots or common.shuffle_partitions(spark)
    c = common.materialize(blocks(candidates, candidate_block), "candidates").repartition(slots, "block")
    q, at = common.stage(blocks(queries, query_block), "queries")
    cutoffs = c.mapInArrow(_gather(k, at), "q_block long, i int, cutoff long").groupBy("q_block", "i").agg(F.max("cutoff").alias("cutoff"))
    listed = cutoffs.groupBy("q_block").agg(F.collect_list(F.struct("i", "cutoff")).alias("cutoffs")).hint("merge")
    _, cut = common.stage(q.join(listed, q["block"] == listed["q_block"], "left").drop("q_block"), "queries-cut")
    common.discard(spark, at)
    found = c.mapInArrow(_resolve(k, cut), FOUND)
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "query_row", "rank", "vec_id", "score")


def op9_exact_top_k(spark, sf_dir: str, k: int = 20) -> DataFrame:
    """Every row whose vec_id is divisible by 20 against all rows of embeddings."""
    v = common.materialize(grid_vectors(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return top_k(v.where(F.col("id") % 20 == 0), v, k).select("query_id", "rank", "vec_id", "score")


OP9_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.own AS own, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON c.own <> q.own WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
