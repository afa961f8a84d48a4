import hashlib
import random

import numpy as np
import pytest
from folioscope.llm import sketch

TOP = 2**64 - 1


def brute(rows):
    """(doc_id, n, edited) in order, as the contract has it."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda x: x[0])
    out = []
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        h = len(t) // 2
        out.append((d, len(t), hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest()))
    return out


def true_likeness(a, b):
    sh = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4)) if w}
    x, y = sh(a), sh(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def low(text):
    """The shingle hashes below the fraction."""
    return {h for h in sketch.shingle_hashes([text])[0].tolist() if h < 2**62}


def likeness(x, y, a, b):
    return len(x & y) / len(x | y) if x | y else float(true_likeness(a, b) == 1)


@pytest.fixture
def texts():
    r = random.Random(4)
    words = ["".join(r.choice("abcdeé😀") for _ in range(4)) for _ in range(3000)]
    return [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 6, 40, 700, 4000]))) for _ in range(60)] + ["", "  ", "x" * 30_000]


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_next_and_edits(spark, texts, parts):
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts)] + [(10_000, None)]
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, part string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sketch.edited_likeness(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == brute(rows)
    by = dict(rows)
    order = sorted(by)
    for r in got:
        t, n = by[r.doc_id] or "", by[order[(order.index(r.doc_id) + 1) % len(order)]] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = (low(x) for x in (t, e, n))
        assert r.near_edited == likeness(a, b, t, e) and r.near_next == likeness(a, c, t, n)
        for x, kept, near in ((e, b, r.near_edited), (n, c, r.near_next)):  # five standard errors of the sample that both keep
            assert not (a | kept) or abs(near - true_likeness(t, x)) < 2.5 / len(a | kept) ** 0.5
        s = sketch.from_text(r.fingerprint)
        assert sketch.to_text(s) == r.fingerprint and set(s.kept.tolist()) == a and s.limit == 2**62 - 1
        assert set(sketch.from_text(r.edited_fingerprint).kept.tolist()) == b


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sketch.edited_likeness(df).count() == 0
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert sketch.edited_likeness(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x"), (2, "a b c d e f")], "doc_id long, text string")
    got = sketch.edited_likeness(same).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 2


@pytest.mark.parametrize("sizes", [(50_000, 300), (200, 200), (3, 1), (0, 40), (1, 0)])
def test_merged_sketches_are_those_of_unions(sizes):
    r = np.random.default_rng(5)
    a, b = (r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) for n in sizes)
    b = np.concatenate((a[: len(a) // 3], b))
    for fraction in (1 / 4, 1 / 64, 1):
        x, y, both = (sketch.sketch(h, fraction) for h in (a, b, np.concatenate((a, b))))
        m = sketch.merge(x, y)
        assert m.limit == both.limit and np.array_equal(m.kept, both.kept)
    lower = sketch.merge(sketch.sketch(a, 1 / 4), sketch.sketch(b, 1 / 64))
    assert np.array_equal(lower.kept, sketch.sketch(np.concatenate((a, b)), 1 / 64).kept)


def test_containment_between_very_unequal_documents():
    r = np.random.default_rng(6)
    a = r.integers(0, 2**63, 50_000, dtype=np.uint64) * np.uint64(2)
    small, large = sketch.sketch(a[:2000]), sketch.sketch(a)
    assert sketch.containment(small, large) == 1.0
    assert abs(sketch.containment(large, small) - 2000 / 50_000) < 0.02
    none = sketch.sketch(np.array([TOP], np.uint64))
    assert not len(none.kept) and sketch.resemblance(none, none) == 1 and sketch.resemblance(none, sketch.sketch(a[:0])) == 0


def test_a_key_that_many_rows_share_is_cut(spark):
    rows = [(7 if i % 3 else i, f"text {i} of many") for i in range(900)] + [(None, f"null {i}") for i in range(300)] + [(7, "same")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    placed = sketch.beside_next(df, "doc_id", "text", 16).where("not extra")
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert sum(sizes) == len(rows) and len(sizes) > 10 and max(sizes) < len(rows) / 4
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.edited_sha256) for r in sketch.edited_likeness(df).collect())
    h = {t: x for t, x in df.selectExpr("text", "xxhash64(text) x").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]]))
    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        k = len(t) // 2
        want.append(((d is not None, d or 0), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    assert got == sorted(want)
