import collections
import itertools
from fractions import Fraction

import pytest
from folioscope.llm import common, mixing, packing
from pyspark.sql import functions as F


def independent(blocks, weights):
    """Sources slot by slot: the plainest earliest-deadline-first, over fractions."""
    left = dict(enumerate(blocks))
    left = {s: n for s, n in left.items() if n}
    out = []
    while left:
        total = sum(weights[s] for s in left)
        w = {s: Fraction(weights[s]) / total for s in left}
        had, t = dict.fromkeys(left, 0), 0
        while all(left.values()):
            released = [s for s in left if had[s] / w[s] // 1 <= t]
            s = min(released, key=lambda s: (-(-(had[s] + 1) / w[s] // 1), s))
            had[s] += 1
            left[s] -= 1
            t += 1
            out.append(s)
        left = {s: n for s, n in left.items() if n}
    return out


def flat(blocks, share):
    return [(int(s), int(k)) for a, b in mixing.schedule(blocks, share) for s, k in zip(a, b)]


@pytest.mark.parametrize("weights", [[1, 1, 1], [Fraction(1, 3), Fraction(1, 2), Fraction(1, 6)], [7], [5, 3, 1, 1], [0.61, 0.27, 0.12], [101, 57, 3, 2, 1]])
@pytest.mark.parametrize("blocks", [[40, 25, 31, 9, 60], [3, 300, 50, 0, 1], [1, 1, 1, 1, 1]])
def test_schedule_is_earliest_deadline_first(blocks, weights):
    blocks = blocks[: len(weights)]
    share = mixing.shares(weights)
    got = flat(blocks, share)
    assert [s for s, _ in got] == independent(blocks, share)
    assert sorted(got) == [(s, k) for s, n in enumerate(blocks) for k in range(n)]
    assert all([k for s, k in got if s == x] == list(range(n)) for x, n in enumerate(blocks))


@pytest.mark.parametrize("weights", [[1, 1, 1], [1 / 3, 1 / 3, 1 / 3], [0.9, 0.1], [0.123456789, 0.7, 0.05, 2], [1] * 40 + [1000]])
def test_deviation_stays_under_a_block_at_any_length(weights):
    """Against the target weights themselves, 100,000 slots long."""
    total = sum(Fraction(str(w)) if isinstance(w, float) else Fraction(w) for w in weights)
    target = [(Fraction(str(w)) if isinstance(w, float) else Fraction(w)) / total for w in weights]
    had = [0] * len(weights)
    pieces = mixing.schedule([10**6] * len(weights), mixing.shares(weights))
    for t, s in enumerate(itertools.islice(itertools.chain.from_iterable(a.tolist() for a, _ in pieces), 100_000), 1):
        had[s] += 1
        lag = had[s] - target[s] * t
        assert lag < 1
        if t % 500 == 0 or t < 200:
            assert all(abs(h - w * t) < 1 for h, w in zip(had, target))


def test_periods_too_long_to_keep(monkeypatch):
    blocks, share = [900, 500, 77], [531, 210, 97]
    want = flat(blocks, share)
    for period, chunk in ((10, 16), (10**6, 7)):
        monkeypatch.setattr(mixing, "PERIOD", period)
        monkeypatch.setattr(mixing, "CHUNK", chunk)
        assert flat(blocks, share) == want


def test_shares_are_exact():
    assert mixing.shares([0.9, 0.1]) == [9, 1] and mixing.shares([Fraction(1, 3), 1]) == [1, 3] and mixing.shares([4, 6]) == [4, 6]
    for bad in ([0], [1, -1], [0.0]):
        with pytest.raises(ValueError):
            mixing.shares(bad)


@pytest.mark.parametrize("limit", [10**6, 0])
@pytest.mark.parametrize("weights", [None, {"hot": 0.7, "s1": 0.1, None: 0.05}])
def test_mix(spark, monkeypatch, weights, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 4}", 7) for i in range(1000)] + [(1, "t1", "hot", 7)] * 3 + [(None, None, None, 7), (None, "x", None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _id int")
    got = mixing.mix(df, "source", ["doc_id", "text"], weights, block=8).collect()
    assert sorted((r.doc_id or -1, r.text or "", r.source or "") for r in got) == sorted((d or -1, t or "", s or "") for d, t, s, _ in rows)
    sizes = collections.Counter(r[2] for r in rows)
    names = sorted(sizes, key=lambda s: (s is not None, s))
    share = mixing.shares([mixing.tempered(sizes[s]) if weights is None else weights.get(s, 1) for s in names])
    order = independent([-(-sizes[s] // 8) for s in names], share)
    by = {}
    for r in got:
        assert names[order[r.slot]] == r.source and order[: r.slot].count(order[r.slot]) == r.block and 0 <= r.place < 8
        assert r.share == share[names.index(r.source)]
        by.setdefault(r.source, []).append((r.block * 8 + r.place, r.doc_id or -1))
    for s, ranks in by.items():
        ranks.sort()
        assert [k for k, _ in ranks] == list(range(sizes[s])) and [d for _, d in ranks] == sorted(d for _, d in ranks)
    assert len({(r.slot, r.place) for r in got}) == len(rows)


def test_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "s", 1, 2, 3), (2, "b", "s", 4, 5, 6)], "doc_id long, text string, source string, slot int, place int, r int")
    assert mixing.mix(df.limit(0), "source", ["doc_id", "text"]).count() == 0
    out = mixing.mix(df, "source", ["doc_id"])
    assert out.columns == [*df.columns, "block", "slot_", "place_", "share"]
    assert sorted((r.doc_id, r.slot, r.slot_, r.place_) for r in out.collect()) == [(1, 1, 0, 0), (2, 4, 0, 1)]


def test_mixed_order(spark):
    rows = [(i, f"t{i}", f"s{i % 3}", 1) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    out = [r.source for r in mixing.mixed_order(df, "source", "doc_id", "text").collect()]
    assert len(out) == 600
    for n in (192, 384):
        assert all(abs(out[:n].count(f"s{k}") - n / 3) < 64 for k in range(3))


def test_order_survives_staging(spark):
    """Rows are read again in few partitions of many files, whose order Spark doesn't keep; the packer does."""
    import public_tokenizers

    rows = [(i, "word " * (1 + i * 7919 % 97), f"s{i * i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slots = {r.doc_id: (r.slot, r.place) for r in mixing.mix(df.withColumn("th", F.xxhash64("text")), "source", ["doc_id", "th"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        staged = common.materialize(mixing.mixed_order(df, "source", "doc_id", "text"), "mixed")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert staged.columns == df.columns and len(staged.inputFiles()) > 30
    packed = packing.pack(packing.in_file_order(staged), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json")).withColumn("p", F.spark_partition_id()).collect()
    for _, part in itertools.groupby(packed, key=lambda r: r.p):
        seen = [slots[r.doc_id] for r in part]
        assert seen == sorted(seen)
    assert packing.in_file_order(df.limit(3)).count() == 3
