"""Passages of over 50 words that repeat, however short their words, against brute force over all windows."""

import random
import re

import corpus_pipeline as pipeline
import numpy as np
import pytest
from folioscope.llm import exactdedup

BLANKS = re.compile(rb"[^\t\n\v\f\r ]+")


def brute(texts, words, length):
    """The bytes of each text that lie in no window of words that another has too, and no string of ``length`` bytes that occurs again."""
    data = [t.encode() for t in texts]
    bounds = [[m.span() for m in BLANKS.finditer(t)] for t in data]
    seen = {}
    for t, b in zip(data, bounds):
        for k in [*{tuple(t[x:y] for x, y in b[i : i + words]) for i in range(len(b) - words + 1)}, *(t[i : i + length] for i in range(len(t) - length + 1))]:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for t, b in zip(data, bounds):
        gone = bytearray(len(t))
        spans = [(b[i][0], b[i + words - 1][1]) for i in range(len(b) - words + 1) if seen[tuple(t[x:y] for x, y in b[i : i + words])] > 1]
        spans += [(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]
        for x, y in spans:
            gone[x:y] = b"\1" * (y - x)
        out.append(bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore"))
    return out


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeß") for _ in range(r.randrange(1, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    passages = [line(n) for n in (50, 51, 52, 63, 90)] + ["a " * 60, "\n".join(word() for _ in range(55))]
    out = ["", line(51), line(400)]
    for _ in range(60):
        p = r.choice(passages)
        if r.random() < 0.2:
            p = p.replace(" ", "  ")
        out.append(line(r.randrange(1, 80)) + " " + p + r.choice([" ", "\n", "x "]) + line(r.randrange(1, 80)))
    alone = " ".join(r.choice("fgh") for _ in range(70))
    return [*out, passages[0] + " " + line(3), passages[0], out[4], out[4], f"{alone} x {alone}"]


@pytest.mark.parametrize("hot", [10**6, 3])
def test_short_passages(spark, hot):
    rows = list(enumerate(texts(hot)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marked = exactdedup.with_spans(df, "doc_id", "text", hot=hot, words=51).collect()
    want = brute([t for _, t in rows], 51, 400)
    got = {r.id: exactdedup.kept(r.text.encode(), exactdedup.merged(exactdedup.located(r.text.encode(), r.spans))).decode("utf-8", "ignore") for r in marked}
    assert [got[i] for i in range(len(rows))] == want
    assert sum(a != b for (_, a), b in zip(rows, want)) > 30


def test_stage(spark):
    rows = [(i, t, len(t)) for i, t in enumerate(texts(9))]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(5)
    want = brute([t for _, t, _ in rows], 51, 400)
    got = sorted((r.doc_id, r.text, r.n_chars) for r in pipeline.repeats_out(spark, df, "").collect())
    assert got == [(i, t, len(t)) for i, t in enumerate(want)]


def test_long_texts_are_cut_into_pieces(monkeypatch):
    r = random.Random(4)
    t = b"".join(bytes(r.choice(b"abc") for _ in range(r.choice([1, 3, 9, 2000 if r.random() < 0.01 else 4]))) + r.choice([b" ", b"\n\n"]) for _ in range(3000))
    start, end = exactdedup.word_bounds(t)
    whole = exactdedup.word_hashes(t, start, end)
    _, first, last = exactdedup.word_anchors(t, np.array([len(t)]), 51)
    monkeypatch.setattr(exactdedup, "SEGMENT", 1000)
    assert (exactdedup.word_hashes(t, start, end) == whole).all()
    served = []
    for at, piece in exactdedup._word_pieces(t, 51):
        _, a, b = exactdedup.word_anchors(piece, np.array([len(piece)]), 51)
        served += [x for lo, hi in zip(a + at, b + at) for x in range(np.searchsorted(start, lo), np.searchsorted(end, hi) - 49)]
    assert served == list(range(len(start) - 50))
    assert first[0] == start[0] and last[-1] == end[-1]


def test_query_counts_passages(spark, tmp_path):
    rows = list(enumerate(texts(5)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in exactdedup.op3_suffix_dedup(spark, str(tmp_path)).collect()}
    data = [t for _, t in rows]
    for i, short in enumerate(brute(data, 51, 10**9)):
        assert got[i].n_passage_bytes == len(data[i].encode()) - len(short.encode()) and bool(got[i].n_passages) == (short != data[i])
    assert sum(r.n_passages > 0 and not r.n_removed for r in got.values()) > 5 and got[len(rows) - 1].n_passages == 0
