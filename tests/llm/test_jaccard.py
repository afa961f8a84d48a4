"""Near copies of 5-word-shingle likeness 0.8 and more, against brute force over all pairs."""

import random

import corpus_pipeline as pipeline
import numpy as np
import pytest
from folioscope.llm import jaccard, simhash


def brute_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def texts():
    r = random.Random(23)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    line = [word() for _ in range(30)]  # in many texts, so frequent in any sample
    out = []
    for _ in range(60):
        w = [word() for _ in range(r.randrange(1, 160))] + (line if r.random() < 0.5 else [])
        out.append(" ".join(w))
        for edits in range(r.randrange(4)):
            v = list(w)
            for _ in range(edits + 1):
                v[r.randrange(len(v))] = word()
            out.append(" ".join(v) + (" " + word()) * r.randrange(3))
    return [*out, out[0], out[0].upper(), "", None, "one", "One", "a b c d e", "a b c d e f", " ".join(line), " ".join(line[1:])]


def test_sketches_rule_out_no_near_copy():
    r = random.Random(3)
    ruled_out = 0
    for _ in range(300):
        n = r.choice([1, 5, 60, 64, 65, 120, 130, 1000, 1100])
        x = {r.getrandbits(64) for _ in range(n)}
        y = {r.getrandbits(64) if r.random() < r.choice([0, 0.05, 0.1, 0.5]) else h for h in x} | {r.getrandbits(64) for _ in range(r.randrange(1 + n // 8))}
        a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
        ok = jaccard.may_be_alike(jaccard.sketch(a), jaccard.sketch(b), len(a) + len(b))
        assert ok or 5 * len(x & y) < 4 * len(x | y)
        ruled_out += not ok
    assert ruled_out > 30


@pytest.mark.parametrize("often", [1, 8])
def test_all_near_copies_link(spark, monkeypatch, often):
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "OFTEN", often)
    rows = texts()
    sets = [brute_set(t) for t in rows]
    root = list(range(len(rows)))
    wide = 0
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                wide += (simhash.fingerprint(rows[i]) ^ simhash.fingerprint(rows[j])).bit_count() > simhash.DISTANCE
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(df).collect()}
    assert [got[i] for i in range(len(rows))] == root
    assert wide > 10 and len(set(root)) < len(rows) - 20
    kept = pipeline.near_duplicates_out(spark, df, "").collect()
    assert {r.doc_id for r in kept} == set(root) and len(kept) == len(set(root))


def test_simhash_groups_link_and_are_not_compared_again(spark, monkeypatch):
    """With no pair from prefix filtering, SimHash still links pairs within its distance; prefix filtering leaves those out."""
    r = random.Random(29)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    for _ in range(25):
        w = [word() for _ in range(150)]
        v = [*w[:-1], word()]  # likeness 145/147
        far = [x if i % 6 else word() for i, x in enumerate(v)]  # far under 0.8, and of no group
        rows += [" ".join(w), " ".join(v), " ".join(far)]
    sets = [brute_set(t) for t in rows]
    like = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    bits = lambda i, j: (simhash.majority(jaccard.shingles(rows[i])) ^ simhash.majority(jaccard.shingles(rows[j]))).bit_count()
    near = [i for i in range(0, len(rows), 3) if bits(i, i + 1) <= jaccard.DISTANCE]
    assert len(near) > 20 and all(like(i, i + 1) and not like(i, i + 2) and bits(i, i + 2) > jaccard.DISTANCE for i in near)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    found, candidates = [], jaccard._candidates

    def none(postings):
        found.append(candidates(postings).collect())
        return candidates(postings).limit(0)

    monkeypatch.setattr(jaccard, "_candidates", none)
    out = jaccard.near_copies(df).collect()
    got, digest = ({r.doc_id: r[c] for r in out} for c in ("component_id", "f"))
    assert [i for i in range(0, len(rows), 3) if got[i + 1] == i] == near
    assert all(got[i + 2] == i + 2 for i in range(0, len(rows), 3))
    again = {tuple(p) for p in found[0]}
    assert not any(tuple(sorted((digest[i], digest[i + 1]))) in again for i in near)


def test_a_group_that_simhash_links_wrongly_is_not_linked(spark, monkeypatch):
    """Every text is put in one group: links still are those of whole sets, all of them."""
    monkeypatch.setattr(jaccard, "_fingerprint_pairs", lambda marked: marked.crossJoin(marked.agg({"f": "min"}).toDF("a")).where("n > 0 and f <> a").selectExpr("a", "f b").distinct())
    test_all_near_copies_link(spark, monkeypatch, 8)
