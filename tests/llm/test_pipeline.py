"""Each stage over what the one before it kept, against brute force."""

import random
import zlib

import corpus_pipeline as pipeline
import numpy as np
import pytest
from folioscope.llm import common, packing
from test_exactdedup import brute as brute_repeats
from test_simhash import brute_components, brute_print
from test_toxicity import corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "extra"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    r = random.Random(17)
    docs, labels = corpus(600)
    word = lambda: "".join(r.choice("abcdefgh ß") for _ in range(6))
    passage = " ".join(word() for _ in range(90))
    rows = [[i, t, l, f"s{i % 3}", len(t), 5] for i, t, l, _, _ in docs]
    for i in range(40):
        t = " ".join(word() for _ in range(60))
        rows.append([1000 + i, t + passage + t[::-1], "xx", "hot", 0, 5])
    rows += [[2000 + i, rows[-1][1], "xx", "hot", 0, 5] for i in range(5)] + [[2100, rows[-2][1], None, None, 0, 5]] * 3
    rows += [[3000, None, "xx", "s1", None, 5], [3001, "", "xx", "s1", 0, 5], [None, "a text without id " + word() * 30, "xx", None, 1, 5], [None, "b other " + word() * 30, None, None, 1, 5]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra int").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    out = [common.table(spark, str(folder), "documents")]
    for _, stage in pipeline.STAGES:
        out.append(common.materialize(stage(spark, out[-1], str(folder)), "stage"))
    return out, dict((a, c) for a, _, c in labels), str(folder)


def test_names_and_columns(stages):
    out = stages[0]
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash near-dedup", "suffix-array dedup", "mixing", "best-fit packing"]
    assert all(d.dtypes == out[0].dtypes for d in out[:5]) and out[0].columns == COLUMNS


def test_toxic_documents_go_and_clean_ones_stay(stages):
    out, truth, _ = stages
    before, after = ({r.doc_id for r in d.collect()} for d in out[:2])
    wrong = [i for i, t in truth.items() if (i in after) == bool(t)]
    assert len(wrong) < 0.02 * len(truth) and {i for i in before if i not in truth} <= after
    assert out[1].where("doc_id is null").count() == 2


def test_one_of_each_group_stays(stages):
    before, after = (stages[0][k].collect() for k in (1, 2))
    prints = [(r.doc_id, brute_print(r.text)) for r in before]
    groups = {}
    for r, c in zip(before, brute_components(prints)):
        groups.setdefault(("null", r.text) if c is None else c, []).append(r)
    assert len(after) == len(groups)
    assert {r.doc_id for r in after if r.doc_id is not None} == {c for c in groups if not isinstance(c, tuple)}


def test_repeats_go(stages):
    before, after = (stages[0][k].collect() for k in (2, 3))
    want = brute_repeats([r.text for r in before], 400)
    by = {r.doc_id: r for r in after}
    assert len(after) == len(before) and sum(w[1] for w in want) > 10_000
    for r, (_, removed, _, sha) in zip(before, want):
        if r.doc_id is None:
            continue
        new = by[r.doc_id]
        if not removed:
            assert (new.text, new.lang, new.source, new.extra) == (r.text, r.lang, r.source, r.extra)
        else:
            assert len(r.text.encode()) - removed - 8 <= len(new.text.encode()) <= len(r.text.encode()) - removed
        assert new.n_chars == (None if new.text is None else len(new.text))


def test_mixing_keeps_every_row(stages):
    assert sorted(map(str, stages[0][3].collect())) == sorted(map(str, stages[0][4].collect()))


def test_packing_holds_every_document(stages):
    kept, pieces = stages[0][4].collect(), stages[0][5].collect()
    assert len(pieces) == len(kept) and {r.doc_id for r in kept} == {p.doc_id for p in pieces}
    assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 and packing.token_ids(bytes(p.ids))[-1] == 1 for p in pieces)
    assert np.sum([p.length for p in pieces]) <= 4096 * len({p.sequence_id for p in pieces})


def test_run(spark, stages):
    assert pipeline.run(spark, stages[2]).count() == stages[0][5].count()


def test_empty_tables(spark, stages):
    out, _, folder = stages
    for (_, stage), docs in zip(pipeline.STAGES, out):
        assert stage(spark, docs.limit(0), folder).count() == 0
