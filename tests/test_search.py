import pytest
from folioscope.functions import binary, text
from folioscope.functions.ranking import with_rank
from folioscope.operators import search, suggest
from folioscope.operators.search import Query, parse_query
from pyspark.sql import functions as F


def test_parse_query():
    assert parse_query("site:Example.org namespace:A +Must may may other:thing + site:") == Query(("may", "other:thing"), ("must",), ("example.org",), ("A",))
    assert parse_query("").empty and parse_query(None).empty and parse_query("  + ").empty


@pytest.fixture(scope="module")
def entries(spark):
    rows = [("x", "en", "http://a.example.net/cat", "The Dog"), ("x", "en", "https://example.net/", "Cat and dog"), ("x", "de", "http://myexample.net/b", "Cat"), ("y", "en", "no url, CAT", ""), ("x", None, "http://example.net:80/q", None)]
    df = spark.createDataFrame(rows, "archive string, namespace string, path string, title string")
    return df.withColumn("full_path", F.concat(F.coalesce("namespace", F.lit("-")), F.lit("/"), "path")).cache()


@pytest.mark.parametrize(
    "query,paths",
    [
        ("cat", ["en/https://example.net/", "de/http://myexample.net/b", "en/http://a.example.net/cat", "en/no url, CAT"]),
        ("site:example.net", ["-/http://example.net:80/q", "en/http://a.example.net/cat", "en/https://example.net/"]),
        ("site:example.net +dog cat", ["en/http://a.example.net/cat", "en/https://example.net/"]),
        ("namespace:de namespace:en +cat +dog", ["en/http://a.example.net/cat", "en/https://example.net/"]),
        ("+zebra cat", []),
        ("", []),
    ],
)
def test_search(entries, query, paths):
    assert sorted(r.full_path for r in search.search(entries, query).collect()) == sorted(paths)


def test_order_bookmarks_and_suggestions(spark, entries):
    assert [r.score for r in search.search(entries, "cat dog").collect()] == [4, 3, 2, 1]
    marks = spark.createDataFrame([("y", "en/no url, CAT", 2), ("x", "gone", 9)], "archive string, full_path string, votes long")
    top = search.boosted(search.search(entries, "cat", limit=None), marks).collect()
    assert top[0].full_path == "en/no url, CAT" and top[0].votes == 2 and len(top) == 4
    more = search.vote(marks.withColumn("updated", F.current_timestamp()), marks.limit(1).withColumn("updated", F.current_timestamp()))
    assert {r.full_path: r.votes for r in more.collect()} == {"en/no url, CAT": 4, "gone": 9}
    assert [(r.title, r.shared) for r in suggest.suggest(entries, "a DOG and zebra").collect()] == [("Cat and dog", 2), ("The Dog", 1)]
    assert {r.token: r.uses for r in suggest.token_counts(entries).collect()} == {"the": 1, "dog": 2, "cat": 2, "and": 1}


def test_binary_expressions(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04\x05\x06\x07\x08" + bytes(range(16)) + b"a\0bc\0\0d"),), (bytearray(b"\xff" * 8),)], "b binary")
    got = df.select(
        binary.unsigned(df.b, 0, 2).alias("u16"), binary.unsigned(df.b, 0, 8).alias("u64"), binary.unsigned(df.b, 7, 4).alias("over"), binary.uuid_text(df.b).alias("uuid"), binary.nul_list(F.substring(df.b, 25, 100)).alias("names"), binary.trim_nul(F.lit("x\0\0")).alias("t")
    ).collect()
    assert (got[0].u16, got[0].u64, got[0].uuid, got[0].names, got[0].t) == (0x0201, 0x0807060504030201, "00010203-0405-0607-0809-0a0b0c0d0e0f", ["a", "bc"], "x")
    assert got[1].u16 == 0xFFFF and got[1].u64 is None and got[1].over is None and got[1].uuid is None


def test_text_expressions(spark):
    df = spark.createDataFrame([("http://Sub.Example.org:8/en?x", "a  b c"), ("no", "")], "u string, w string")
    got = df.select(text.host(df.u).alias("h"), text.language_segment(df.u).alias("l"), text.words(df.w).alias("w"), text.tokens(F.lit("Ünder_score, 2x")).alias("t"), text.first_line(F.lit("a\nb")).alias("f"), text.html_title(F.lit("<title>x</title>")).alias("x")).collect()
    assert (got[0].h, got[0].l, got[0].w, got[0].t, got[0].f, got[0].x) == ("sub.example.org", "en", ["a", "b", "c"], ["ünder", "score", "2x"], "a", "x")
    assert got[1].h == "" and got[1].w == []


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_ranks(spark, parts):
    rows = [(f"a{i % 2}", None if i % 11 == 0 else f"k{(i * 37) % 20:02d}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k string, i long")
    got = {r.i: r.place for r in with_rank(df, ["g"], "k", ["i"], "place", parts).collect()}
    for g in ("a0", "a1"):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        assert [got[i] for _, _, i in order] == list(range(len(order)))


def test_ports_and_settings(spark):
    rows = [(x,) for x in ("1", "65534", "65535", "0", "080", "-1", "1.5", "", " 80", "9" * 30, None)]
    got = [r.p for r in spark.createDataFrame(rows, "x string").select(text.port(F.col("x")).alias("p")).collect()]
    assert got == [1, 65534, None, None, 80] + [None] * 6
    rows = [('{"a": "x", "b": 2, "c": null}',), ("{}",), ("nothing",), (None,)]
    m = text.settings(F.col("j"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "j string").select(*[text.setting(m, k, "-") for k in "abcd"]).collect()]
    assert got == [("x", "2", None, "-"), *[("-",) * 4] * 3]
