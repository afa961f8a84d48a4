import math
import random

import numpy as np
import pyarrow as pa
import pytest
from folioscope.llm import common, topk


def brute(rows, k, every=20):
    vs = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, qv) in enumerate(vs):
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(qv, cv)), c) for b, (c, cv) in enumerate(vs) if a != b)[:k]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, k=20, **sizes):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    v = common.materialize(topk.grid_vectors(df, "vec_id", "embedding"), "vectors")
    return sorted(tuple(r) for r in topk.top_k(v.where("id % 20 = 0"), v, k, **sizes).drop("query_row").collect())


@pytest.mark.parametrize("sizes", [{}, {"query_block": 4, "candidate_block": 30, "slots": 3}, {"query_block": 1, "candidate_block": 7, "slots": 1}])
def test_matches_brute_force(spark, sizes):
    r = random.Random(14)
    rows = [(i, [r.choice([r.gauss(0, 0.3), 0.0, 0.5]) for _ in range(9)]) for i in range(-60, 240)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(None, [1.0] * 9), (2000, None), (2020, [None] * 9), (2040, [float("nan")] + [0.0] * 8), (2060, [float("inf")] * 9), (20, [9.0] * 9), (3000, []), (3020, [1.0]), (3040, [0.5] * 12)]
    assert run(spark, rows, **sizes) == brute(rows, 20)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0]), (2, [-2.0])]) == [(0, 1, 1, 8192), (0, 2, 2, -8192)]
    assert run(spark, [(0, [1.0])]) == [] and run(spark, [(1, [1.0]), (2, [1.0])]) == []
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    v = topk.grid_vectors(df, "vec_id", "embedding")
    assert topk.top_k(v, v, 3).count() == 0


def test_large_components_are_exact(spark):
    r = random.Random(15)
    for size in (2.0**10, 2.0**22):
        rows = [(i, [float(r.randrange(-5, 6)) * size for _ in range(6)]) for i in range(60)]
        assert run(spark, rows, 5) == brute(rows, 5)


def clustered(n, clusters, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 20, (clusters, 48))
    return np.floor(centres[r.integers(0, clusters, n)] + r.normal(0, 1, (n, 48))).astype(np.int64)


NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def test_threshold_leaves_out_what_cannot_suffice():
    """Alike queries against clustered candidates: fewer scores are computed than there are pairs, and none that reaches the cutoff is missed."""
    c = clustered(6000, 30, 1)
    q = c[np.argsort(((c - c[0]) ** 2).sum(1))[:50]]
    cut = topk.gather(q, c, NONE, 20)
    full = q @ c.T
    assert (cut <= np.sort(full, axis=1)[:, -20]).all()
    at_q, at_c, score, work = topk.resolve(q, c, NONE, cut)
    assert sorted(zip(at_q.tolist(), at_c.tolist(), score.tolist())) == [(i, j, int(full[i, j])) for i, j in zip(*np.nonzero(full >= cut[:, None]))]
    assert work < 0.6 * full.size


def test_short_candidates_are_never_multiplied():
    r = np.random.default_rng(2)
    c = np.concatenate((r.integers(-3, 4, (5000, 32)), r.integers(80, 100, (100, 32))))
    q = r.integers(1, 50, (40, 32))
    cut = topk.gather(q, c, NONE, 10)
    *_, work = topk.resolve(q, c, NONE, cut)
    assert work <= 40 * 100


@pytest.mark.parametrize("scale", [1, 2**20, 2**34])
def test_bounds_hold_at_any_size(scale):
    r = np.random.default_rng(3)
    for dims in (0, 1, 3, 17):
        q, c = (r.integers(-9, 10, (n, dims)) * scale for n in (13, 300))
        own = (np.arange(13), np.arange(13) * 2)
        full = (q @ c.T).astype(np.int64)
        cut = topk.gather(q, c, own, 5)
        at_q, at_c, score, work = topk.resolve(q, c, own, cut)
        want = full >= cut[:, None]
        want[own] = False
        assert (np.stack((at_q, at_c)) == np.stack(np.nonzero(want))).all() and (score == full[want]).all() and work <= full.size


def test_queries_are_never_broadcast(spark):
    """However many tasks there are: queries reach them through the shared folder, not through the driver."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsCount()
    r = random.Random(16)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(8)]) for i in range(200)]
    assert run(spark, rows, query_block=4, candidate_block=30, slots=9) == brute(rows, 20)
    executions = store.executionsList(int(seen), 1000)
    plans = [executions.apply(i).physicalPlanDescription() for i in range(executions.size())]
    assert any("MapInArrow" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_held_candidates_are_bounded():
    t = pa.table({"block": range(7), "data": [bytes(n) for n in (3, 4, 5, 30, 1, 2, 3)]})
    assert [[c["block"] for c in held] for held in topk._held(t.to_batches(2), 10)] == [[0, 1], [2], [3], [4, 5, 6]]
