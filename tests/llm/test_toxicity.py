import random
import zlib

import numpy as np
import pytest
from folioscope.llm import toxicity as tox
from pyspark.sql import functions as F


def corpus(n, seed=8):
    r = random.Random(seed)
    plain = ["".join(r.choice("abehlmnorst") for _ in range(r.randrange(2, 8))) for _ in range(400)]
    bad = ["grumblef", "snarkoid", "vexel"]
    docs, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.2
        words = [r.choice(plain) for _ in range(r.randrange(3, 80))]
        if toxic:
            for _ in range(r.randrange(1, 4)):
                b = r.choice(bad)
                words.insert(r.randrange(len(words)), b + r.choice(["", "!", "," ]) if b != "vexel" else b + r.choice(plain))
        docs.append((i, " ".join(words).capitalize() + ".", "xx", "src", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus(1500)
    docs += [(None, "no id", "xx", "s", 1), (9001, None, None, None, None), (9002, "", "xx", "s", 0), (9003, "snarkoid " * 20_000, "xx", "s", 0)]
    labels += [(None, 1, 1), (3, 1, None), (9002, None, None), (labels[0][0], 0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, c) for a, _, c in labels[:1500])


def test_held_out_accuracy(frames):
    docs, labels, truth = frames
    model = tox.train(docs, labels)
    out = {r.doc_id: r.score for r in tox.scored(docs.drop("score"), model).collect()}
    test = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == bool(truth[i]) for i in test]) > 0.97
    assert out[9001] == out[9002] < 0.5 < out[9003] and 0 <= min(out.values()) and max(out.values()) <= 1
    assert any(w.startswith("vexe") for w in model.stems) and "grumblef" in model.words


def test_held_out_rows_teach_nothing(frames, spark):
    docs, labels, truth = frames
    flipped = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in truth.items()]
    a = tox.train(docs, spark.createDataFrame([(i, 1, t) for i, t in truth.items()], "doc_id long, quality int, toxic int"))
    b = tox.train(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert a.words == b.words and a.stems == b.stems and np.array_equal(a.weights, b.weights)


def test_no_labels(spark, frames):
    docs, labels, _ = frames
    model = tox.train(docs, labels.limit(0))
    assert {r.predicted for r in tox.scored(docs.drop("score"), model).selectExpr("cast(score >= 0.5 as int) predicted").collect()} == {0}
    assert tox.scored(docs.drop("score").limit(0), model).count() == 0


def test_patterns_match_clauses():
    s = tox.Scorer(tox.Model({"oaf": 5.0, "cad": 7.0}, {}))
    read = lambda t: [m[:3] for m in s.grammar.matches([s.symbol(w) for w in t.split()])]
    aimed, said, threat = tox.AIMED, tox.SAID_OF, tox.THREATENED
    assert read("oaf") == read("kill") == read("kill the time") == []
    assert read("you oaf") == read("an oaf like you")[:1] == [(aimed, 0, 5.0)]
    assert read("oaf cad") == [(said, 0, 5.0), (said, 0, 7.0)]
    assert read("what an oaf") == read("oaf driver") == [(said, 0, 5.0)]
    assert read("they kill you") == read("kill all of them") == [(threat, 0, 1.0)] and read("you kill") == []
    assert read("not a oaf") == [(said, 1, 5.0)] and read("never kill them") == [(threat, 1, 1.0)]
    assert read("mary said you are an oaf") == [(aimed, 2, 5.0)] and read("mary said oaf") == [(said, 2, 5.0)]
    assert read("what an oaf mary said") == [(said, 2, 5.0)] and read("the oaf said so") == [(said, 0, 5.0)]
    assert read("mary said she is not an oaf") == [(aimed, 3, 5.0)]
    assert read("not then or ever an oaf") == [(said, 0, 5.0)]


def test_clauses_are_scored_not_words():
    s = tox.Scorer(tox.Model({"oaf": 5.0, "cad": 7.0}, {}))
    x = s.features("Fine day. You oaf, you cad, cad! Not so")
    assert x[tox.AIMED * 4] == pytest.approx(np.log1p(12)) and np.count_nonzero(x[:12]) == 1 and x[-1] == pytest.approx(1 / 3)
    for t in ("", "oaf", "Oaf!!", "nothing here. at all", "Kill time. You are here"):
        assert not s.features(t).any()
    assert s.features("What. Oaf!").any() and s.features("Oaf! What is this").any() and s.features("This is it. Oaf").any()
    s.MEMO = 3
    assert (s.features("Fine day. You oaf, you cad, cad! Not so") == x).all()


def test_repeated_ids_and_clashing_names(spark, frames):
    docs, labels, _ = frames
    model = tox.train(docs, labels)
    again = tox.train(docs.union(docs).union(docs.withColumn("text", F.concat("text", F.lit(" ")))), labels)
    assert again.words == model.words and again.stems == model.stems
    out = tox.scored(docs.limit(5), model)
    assert out.columns == [*docs.columns, "score_"] and [r.score for r in out.collect()] == [r.score for r in docs.limit(5).collect()]
