import itertools
import random
import zlib

import numpy as np
import pytest
import pyarrow.parquet as pq
from folioscope.llm import common, hilbert
from pyspark.sql import functions as F


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_curve_visits_every_cell_and_moves_one_step(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims))).T
    index = hilbert.hilbert_index(cells, bits)
    assert sorted(index) == list(range(1 << bits * dims))
    path = cells[:, np.argsort(index)]
    assert (np.abs(np.diff(path, axis=1)).sum(0) == 1).all()


@pytest.mark.parametrize("n,shards", [(0, 24), (5, 24), (24, 24), (1000, 7), (101, 1)])
def test_shards(spark, n, shards):
    r = random.Random(16)
    rows = [(i if i % 10 else None, r.choice(["aa", "bb", None]), r.choice([0, 5, 900, 10**9, None])) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, size long")
    dims = {"lang": F.col("_cell0"), "size": hilbert.magnitude(F.col("size"), 6)}
    out = hilbert.shard_by_curve(hilbert.with_cells(df, ["lang"], 6), dims, shards, bits=6).collect()
    assert sorted(map(str, ((x.doc_id, x.lang, x.size) for x in out))) == sorted(map(str, rows))
    by = {}
    for x in out:
        by.setdefault(x.shard, []).append((x.slot, x.hilbert))
    for rows_ in by.values():
        rows_.sort()
        assert [s for s, _ in rows_] == list(range(len(rows_))) and [h for _, h in rows_] == sorted(h for _, h in rows_)
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(shards))
    ends = [by[s][-1][1] for s in sorted(by)]
    assert ends == sorted(ends)


def test_query_and_written_shards(spark, tmp_path):
    rows = [(i, f"text ü {i % 50}" * (i % 7), "en" if i % 3 else None, f"s{i % 4}", 1) for i in range(300)] + [(300, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = hilbert.op10_hilbert_sharding(spark, str(tmp_path)).collect()
    by = {r[0]: (r[1] or "").encode() for r in rows}
    assert len(out) == 301 and all((x.size, x.text_crc32, x.law, x.grown_shard) == (len(by[x.doc_id]) + 8, zlib.crc32(by[x.doc_id]), "rows", None) for x in out)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    placed = hilbert.op10_hilbert_sharding(spark, str(tmp_path))
    hilbert.write_shards(docs, placed, ["doc_id"], str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 301 and back.select("shard").distinct().count() == 24


@pytest.mark.parametrize("limit", [10**6, 0])
def test_cells_rise_with_labels(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    r = random.Random(18)
    rows = [(i, f"s{r.randrange(1000):04d}" if i % 7 else None, r.choice(["b", "a", None])) for i in range(2000)]
    got = hilbert.with_cells(spark.createDataFrame(rows, "i long, many string, few string"), ["many", "few"], 4).collect()
    assert len(got) == 2000
    for name, cell in (("many", "_cell0"), ("few", "_cell1")):
        pairs = sorted({(x[name] or "", x[cell]) for x in got})
        assert [c for _, c in pairs] == sorted(c for _, c in pairs) and pairs[0] == ("", 0) and pairs[1][1] == 1 and len(pairs) == len({x[name] for x in got})
        assert max(c for _, c in pairs) <= 15 and len({c for _, c in pairs}) == min(16, len(pairs))


def test_written_shards_prune_every_dimension(spark, tmp_path):
    """Files whose footers let a filter skip them, for one language, one source and one range of sizes."""
    r = random.Random(19)
    rows = [(i, "x" * r.choice([10, 80, 700, 6000]), r.choice(["de", "en", "es", "fr"]), f"s{r.randrange(8)}", 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumn("size", F.octet_length("text"))
    hilbert.write_shards(docs, hilbert.op10_hilbert_sharding(spark, str(tmp_path)).drop("size"), ["doc_id"], str(tmp_path / "shards"), files=48)
    files = list((tmp_path / "shards").rglob("*.parquet"))
    assert len(files) >= 48

    def read(column, value):
        n = 0
        for f in files:
            meta = pq.ParquetFile(f)
            at = meta.schema_arrow.names.index(column)
            n += any((s := meta.metadata.row_group(k).column(at).statistics).min <= value <= s.max for k in range(meta.metadata.num_row_groups))
        return n / len(files)

    assert read("lang", "es") < 0.6 and read("source", "s3") < 0.6 and read("size", 6000) < 0.6


def test_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, -1, "h", 9) for i in range(50)], "slot long, d0 int, Shard int, hilbert string, r int")
    out = hilbert.shard_by_curve(df, {"d": F.col("d0")}, 4, bits=4, tie=["slot"])
    assert out.columns == ["slot", "d0", "Shard", "hilbert", "r", "hilbert_", "shard_", "slot_"]
    rows = out.collect()
    assert sorted(r.slot for r in rows) == list(range(50)) and {r.shard_ for r in rows} == {0, 1, 2, 3} and all(r.Shard == -1 and r.r == 9 for r in rows)
    placed = out.select(F.col("slot").alias("id"), F.col("shard_").alias("shard"), F.col("slot_").alias("slot"))
    hilbert.write_shards(df.select(F.col("slot").alias("id"), "Shard", "r"), placed, ["id"], str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 50 and set(back.columns) == {"id", "Shard", "r", "slot", "shard_"}
