import gzip
import hashlib
import io
import zlib

import pytest
from folioscope.llm import warc
from pyspark.sql import functions as F

BIG, BIG2 = b"<p>" + b"x" * 2000, b"y" * 1000
ROWS = [
    (1, "http://a/", BIG), (7, "http://b/\r\nX: y", BIG), (3, None, BIG), (2, "u", b"small"), (4, "u", b"small"), (5, "u", b""), (6, "u", BIG2),
    (8, "u", b"z" * 999), (9, "u", b"z" * 999), (None, "n", BIG), (10, "u", BIG2 + b"\r\n\r\nWARC/1.1\r\n"), (7, "http://b/", BIG), (6, "other", BIG2[:-1] + b"q"), (11, "u", bytes(range(256)) * 5000),
]


def want(rows):
    top = {}
    for i, _, p in rows:
        if len(p) >= 1000 and i is not None:
            top[p] = max(i, top.get(p, i))
    out = []
    for i, _, p in rows:
        again = p in top and i != top[p]
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", top[p] if again else None))
    return sorted(map(str, out))


def through(spark, tmp_path, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, payload binary").repartition(3)
    whole = warc.write_monolithic(warc.revisits(pages), f"file://{tmp_path}/whole")
    return whole, warc.normalise(whole, f"file://{tmp_path}/members")


def test_round_trip(spark, tmp_path):
    whole, done = through(spark, tmp_path, ROWS)
    out = warc.read(warc.index(done), with_payload=True).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in out) == want(ROWS)
    assert all(bytes(r.payload) in {p for _, _, p in ROWS} for r in out if r.record_type == "response") and all(r.payload is None for r in out if r.record_type == "revisit")
    before = b"".join(sorted(gzip.decompress(open(r.archive[7:], "rb").read()) for r in whole.collect()))
    after = b"".join(sorted(gzip.decompress(open(r.archive[7:], "rb").read()) for r in done.collect()))
    assert before == after and before.count(b"WARC/1.1\r\nWARC-Type") == len(ROWS)
    for r in whole.collect():  # one stream each
        z = zlib.decompressobj(31)
        z.decompress(open(r.archive[7:], "rb").read())
        assert z.eof and not z.unused_data


def test_each_entry_is_a_member_of_its_own(spark, tmp_path):
    _, done = through(spark, tmp_path, ROWS)
    for e in warc.index(done).collect():
        raw = open(e.archive[7:], "rb").read()[e.offset : e.offset + e.length]
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n") and gzip.decompress(raw).endswith(b"\r\n\r\n")
        assert e.id.startswith("<urn:uuid:") and e.type in ("response", "revisit")


def test_normalised_archives_stay_as_they_are(spark, tmp_path):
    _, done = through(spark, tmp_path, ROWS)
    again = warc.normalise(done, f"file://{tmp_path}/again")
    assert sorted(open(r.archive[7:], "rb").read() for r in done.collect()) == sorted(open(r.archive[7:], "rb").read() for r in again.collect())


def test_nothing_and_broken(spark, tmp_path):
    whole, done = through(spark, tmp_path, [(1, "u", b"x")])
    assert warc.read(warc.index(done.limit(0))).count() == 0 and warc.write_monolithic(warc.revisits(spark.createDataFrame([], "page_id long, url string, payload binary")), f"file://{tmp_path}/none").count() == 0
    data = zlib.compress(warc.record(1, "u", b"x" * 5000, None, False)[:-400], 6, 31)
    raw = warc._Inflated(io.BytesIO(data).read)
    raw.head()
    with pytest.raises(ValueError):
        list(raw.pieces(5100))


def test_revisits_ignores_other_columns(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, payload binary").withColumn("digest", F.lit("clash")).withColumn("n", F.lit(1))
    assert warc.revisits(df.select("page_id", "url", "payload")).count() == len(ROWS)


def test_archives_roll_over_by_size(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", b''.join(hashlib.sha512(b'%d %d' % (i, k)).digest() for k in range(40))) for i in range(40)], "page_id long, url string, payload binary").repartition(1)
    whole = warc.write_monolithic(warc.revisits(pages), f"file://{tmp_path}/rolled", level=1, roll=4_000)
    rows = whole.collect()
    assert len(rows) > 2 and sum(r.records for r in rows) == 40 and max(r.bytes for r in rows) < 70_000
    assert warc.read(warc.index(warc.normalise(whole, f"file://{tmp_path}/again"))).count() == 40
