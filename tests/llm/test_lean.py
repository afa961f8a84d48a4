"""Workers are used again, so a task of the pipeline must not leave its memory in one."""

import re
from pathlib import Path

import corpus_pipeline as pipeline
import pyarrow as pa
from folioscope.llm import common, wordbpe
from pyspark.sql.classic.dataframe import DataFrame


def held_mb():
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_what_a_task_frees_goes_back():
    pins = []

    def run(batches):
        for b in batches:
            many = [bytes(2000) for _ in range(100_000)]  # 200 MB
            pins.append(bytes(2000))  # malloc keeps all that lies under it
            del many
            yield b

    batch = pa.RecordBatch.from_pydict({"a": [1, None]})
    before = held_mb()
    assert list(run([batch])) == [batch] and held_mb() - before > 100
    assert list(common.lean(run)([batch])) == [batch] and held_mb() - before < 50


def test_tokenizers_go_unless_they_are_needed(monkeypatch):
    monkeypatch.setattr(wordbpe, "_LOADED", {"a": object()})
    assert list(common.lean(lambda it: it, tokens=True)(iter([]))) == [] and wordbpe._LOADED
    assert list(common.lean(lambda it: it)(iter([]))) == [] and not wordbpe._LOADED


def test_every_python_task_of_the_pipeline_is_lean(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"w{i * j % 97}" for j in range(80)) + (" you are an idiot" if i % 4 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [*rows, (60, rows[1][1])]], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, func, *a, **k: seen.append(func.__qualname__) or plain(self, func, *a, **k))
    for name, stage in pipeline.STAGES:
        seen.clear()
        docs = common.materialize(stage(spark, docs, str(tmp_path)), "stage")
        assert seen and all(q.startswith("lean.") for q in seen), name
