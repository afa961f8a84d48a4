import pandas as pd
from folioscope.operators import log
from folioscope.streaming import events as streams

BASE = "timestamp'2024-01-01 00:00:00'"


def test_sessions_and_duplicates(spark, tmp_path):
    df = spark.range(20).selectExpr("id % 10 as event_id", f"{BASE} + make_interval(0,0,0,0,0,int(id % 10) * 20 + if(id % 10 > 4, 60, 0)) as ts", "id % 10 as user_id", "'view' as event_type", "1.0D as value")
    df.coalesce(1).write.parquet(str(tmp_path / "e.parquet"))
    path = str(tmp_path / "e.parquet")
    once = streams.drain(streams.deduplicated(streams.stream(spark, path)), "dedup", "append")
    assert once.count() == 10
    counts = streams.drain(streams.windowed_counts(streams.stream(spark, path)), "windows").collect()
    assert sum(r.events for r in counts) == 20
    one = streams.stream(spark, path).selectExpr("event_id", "ts", "1 as user_id", "event_type", "value")
    got = streams.drain(streams.sessions(one), "sessions").collect()
    assert sorted(r.events for r in got) == [10, 10]


def test_collapsed_stream_gives_out_all_but_the_open_message(spark, tmp_path):
    texts = ["Parsing 1 of 3 x", "Parsing 2 of 3 x", "Parsing 3 of 3 x", "done", "done", "Export a", "Export b", "stop"]
    rows = [(k, i, "Progress" if t != "stop" else "Log", t) for k in (1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, streams.MESSAGE)
    for n, part in enumerate((df.where("seq < 2"), df.where("seq >= 2"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.drain(streams.collapsed_stream(source), "collapsed", "append").toPandas()
    want = log.collapsed(df, ["log"]).where("seq < 7").toPandas()
    key = ["log", "seq", "method", "value"]
    pd.testing.assert_frame_equal(got.sort_values(key)[key].reset_index(drop=True), want.sort_values(key)[key].reset_index(drop=True), check_dtype=False)
