import hashlib
import random

import numpy as np
import pytest
from folioscope.llm import exactdedup, suffixes


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for t in data:
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def corpus(seed, length):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdé ß\n") for _ in range(n))
    passages = [text(n) for n in (length - 1, length, length + 1, 2 * length, 3 * length)]
    docs = [None, "", "short", "x" * (length - 1), "y" * length, "z" * (length + 1), "ab" * length, text(8 * length)]
    docs += [text(r.randrange(0, 3 * length)) for _ in range(20)]
    for _ in range(40):
        p = r.choice(passages)
        a = r.randrange(0, len(p))
        docs.append(text(r.randrange(0, length)) + (p if r.random() < 0.6 else p[a:]) + text(r.randrange(0, length)))
    docs += [docs[-1], docs[-1], docs[-2], docs[-3][:-1] + "!", docs[30] * 2, passages[0] + passages[0]]
    near = text(4 * length)
    docs += [near[:k] + "#" + near[k + 1 :] for k in (0, length // 2, length, 2 * length, 3 * length)]
    return docs


@pytest.mark.parametrize("length,gram,hot", [(60, 20, 10**6), (60, 20, 3), (60, 20, 12), (400, 128, 10**6), (400, 128, 0)])
def test_documents(spark, length, gram, hot):
    texts = corpus(length + hot, length)
    rows = [(i if i % 9 else None, t, "clash", 0) for i, t in enumerate(texts)] + [(5, texts[5], "clash", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string, start int")
    got = exactdedup.digests(exactdedup.with_spans(df, "doc_id", "text", length, gram, hot)).drop("n_passages", "n_passage_bytes").collect()
    want = [(d, *w) for (d, *_), w in zip(rows, brute([r[1] for r in rows], length))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    if hot > 3:
        assert exactdedup.digests(exactdedup.with_spans(df.limit(0), "doc_id", "text", length, gram)).count() == 0


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "SEGMENT", 1000)
    r = random.Random(6)
    t = "".join(r.choice("abc") for _ in range(5000))
    data = t.encode()
    whole = exactdedup.anchors(data, np.array([len(data)]), 60, 20)
    assert (np.diff(np.append(whole[2], len(data) - 59)) > 0).all() and whole[2][0] == 0 and whole[3][-1] == len(data) - 60
    for g, a, first, last in zip(*whole):
        assert first <= a <= first + 40 and last <= a


def test_deep_shallow_orders_and_prefixes():
    r = random.Random(7)
    strings = [bytes(r.choice(b"a\0") for _ in range(r.randrange(0, 60))) for _ in range(300)]
    strings += [b"a" * 40 + bytes([r.choice(b"ab")]) * r.randrange(0, 9) for _ in range(100)] + [b"", b"", b"a" * 16, b"a" * 16]
    group = np.sort(np.array([r.randrange(3) for _ in strings]))
    order, shared = suffixes.deep_shallow(strings, group)
    assert [(group[i], strings[i]) for i in order] == sorted((g, s) for g, s in zip(group, strings))
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == (n if group[order[k]] == group[order[k - 1]] else -1)


def test_anchors_do_not_hang_on_the_batch():
    r = random.Random(9)
    t = bytes(r.choice(b"ab") for _ in range(3000))
    alone = exactdedup.anchors(t, np.array([len(t)]), 60, 20)
    more = bytes(r.choice(b"cd") for _ in range(400_000))
    among = exactdedup.anchors(more + t, np.array([len(more), len(more) + len(t)]), 60, 20)
    inside = among[1] >= len(more)
    assert all(np.array_equal(x[inside] - (len(more) if k else 0), y) for k, (x, y) in enumerate(zip(among, alone)))
