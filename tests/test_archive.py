import io
import lzma
import struct

import pytest
from archives import content, marker, redirect, write
from folioscope.operators import archive, directory
from folioscope.sources import layout
from folioscope.sources.page_archive import Reader, section
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringStartsWith

UID = "12345678-9abc-def0-1234-56789abcdef0"


def rows(spark, path, name, **options):
    return section(spark, path, name, **options).collect()


def test_round_trip(spark, tmp_path):
    blobs = [[b"one", b"", b"three"], [bytes(range(256)) * 40, "ü".encode()], [b"old"]]
    clusters = [layout.pack_cluster(b, c) for b, c in zip(blobs, (1, 4, 0))]
    entries = [content("a", 0, 0, "Zed"), content("b", 0, 1), content("c", 0, 2, "M"), redirect("d", 1, "R"), content("é", 1, 0, "Ä"), content("x" * 5000, 1, 1, "long"), content("y", 2, 0, "Zed", ns="B", type_=1), content("z", 2, 0, "q", ns="C", type_=9)]
    path = write(tmp_path, "basic", entries, clusters, main_page=2, uid=UID)
    h = rows(spark, path, "header")[0]
    assert (h.archive, h.major, h.uuid, h.entry_count, h.cluster_count, h.main_page, h.layout_page, h.error) == ("basic", 5, UID, 8, 3, 2, None, None)
    assert [(r.mime_idx, r.mime_type) for r in rows(spark, path, "mime")] == [(0, "text/html"), (1, "image/png")]
    got = sorted(rows(spark, path, "entries", entriesPerPartition="3"), key=lambda r: r.entry_id)
    assert [(r.path, r.title, r.namespace) for r in got] == [(e["path"], e["title"], e["namespace"]) for e in entries]
    assert [r.mime_type for r in got] == ["text/html"] * 3 + [None, "text/html", "text/html", "image/png", None]
    assert got[3].redirect_id == 1 and got[3].cluster_id is None and got[0].redirect_id is None
    assert {r.offset for r in rows(spark, path, "paths")} == {r.offset for r in got}
    titles = sorted(rows(spark, path, "titles"), key=lambda r: r.title_rank)
    assert [r.entry_id for r in titles] == sorted(range(8), key=lambda i: (entries[i]["title"].encode(), i))
    ordered = archive.titles_in_order(section(spark, path, "titles"), section(spark, path, "entries")).orderBy("title_rank").collect()
    assert [r.title for r in ordered] == sorted((e["title"] for e in entries), key=str.encode)
    data = {r.entry_id: r.data for r in archive.with_data(section(spark, path, "entries"), section(spark, path, "blobs", clustersPerPartition="1")).collect()}
    assert [bytes(data[i]) if data[i] is not None else None for i in range(8)] == [blobs[0][0], blobs[0][1], blobs[0][2], None, blobs[1][0], blobs[1][1], blobs[2][0], blobs[2][0]]
    assert archive.main_page(section(spark, path, "header"), section(spark, path, "entries")).first().full_path == "A/c"
    shown = {r.entry_id: r.display_title for r in archive.with_display_title(section(spark, path, "entries")).collect()}
    assert shown[0] == "Zed" and shown[1] == "b"


@pytest.mark.parametrize("n", [0, 1, 2, 9])
def test_lookup_finds_every_entry_and_no_other(spark, tmp_path, n):
    path = write(tmp_path, "small", [content(f"p{i}", 0, i) for i in range(n)], [layout.pack_cluster([b"x"] * max(n, 1), 1)])
    e = section(spark, path, "entries")
    for i in range(-1, n + 1):
        assert [r.entry_id for r in directory.lookup(e, f"A/p{i}").collect()] == ([i] if 0 <= i < n else [])
    assert directory.prefixed(e, "A/p").count() == n
    reader = Reader("entries", path, {})
    assert len(list(reader.pushFilters([EqualTo(("full_path",), "A/p1")]))) == 1
    assert sum(p.last - p.first for p in reader.partitions()) == (1 if n > 1 else 0)
    assert archive.main_page(section(spark, path, "header"), e).first().entry_id is None


def test_prefix_narrows_to_its_range(tmp_path):
    path = write(tmp_path, "wide", [content(f"{i:03d}", 0, 0) for i in range(500)], [layout.pack_cluster([b"x"], 1)])
    reader = Reader("entries", path, {})
    list(reader.pushFilters([StringStartsWith(("full_path",), "A/12")]))
    assert [(p.first, p.last) for p in reader.partitions()] == [(120, 130)]


def test_redirects(spark, tmp_path):
    entries = [content("a", 0, 0), redirect("b", 0), redirect("c", 1), redirect("d", 4), redirect("e", 3), redirect("f", 99)]
    path = write(tmp_path, "redirects", entries, [layout.pack_cluster([b"x"], 1)])
    e = section(spark, path, "entries")
    chain = [redirect(f"r{i:02d}", i + 1) for i in range(37)] + [content("x", 0, 0), redirect("y", 38), redirect("z", 40), redirect("zz", 39)]
    long = write(tmp_path, "chain", chain, [layout.pack_cluster([b"x"], 1)])
    ends = {r.entry_id: (r.final_id, r.hops) for r in directory.resolve_redirects(section(spark, long, "entries")).collect()}
    assert ends == {i: (37, 37 - i) for i in range(37)} | {i: (None, None) for i in (38, 39, 40)}
    got = {r.entry_id: (r.final_id, r.hops) for r in directory.resolve_redirects(e).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3][0] is None and got[4][0] is None and got[5][0] is None
    assert [r.entry_id for r in archive.dangling(e).collect()] == [5]
    assert [r.entry_id for r in directory.listing(e).collect()] == []


def test_markers_and_bad_text(spark, tmp_path):
    entries = [marker(layout.LINKTARGET), marker(layout.DELETED), content("p", 0, 0, "t"), {**content("q", 0, 0), "title": b"\xff\xfe"}]
    path = write(tmp_path, "markers", entries, [layout.pack_cluster([b"x"], 1)])
    got = sorted(rows(spark, path, "entries"), key=lambda r: r.entry_id)
    assert [(r.kind, r.path, r.cluster_id, r.error) for r in got[:2]] == [("linktarget", None, None, None), ("deleted", None, None, None)]
    assert got[3].title == "��"


def test_bad_archives(spark, tmp_path):
    good = layout.build([content("a", 0, 0), content("b", 9, 0), content("c", 1, 0)], ["text/html"], [layout.pack_cluster([b"x"], 1)] + [bytes([k]) + b"\4\0\0\0" for k in (2, 3, 5, 0x14)] + [layout.pack_cluster([b"y" * 100], 4)[:-40]])
    for name, data in {"magic": b"\0" + good[1:], "major": good[:4] + struct.pack("<H", 6) + good[6:], "cut": good[:50], "tail": good[:-6], "good": good}.items():
        (tmp_path / name).write_bytes(data)
    errors = {r.archive: r.error for r in rows(spark, str(tmp_path), "header")}
    assert errors["good"] is None and errors["tail"] is None and all(errors[k] for k in ("magic", "major", "cut"))
    e = {(r.archive, r.entry_id): r.error for r in rows(spark, str(tmp_path / "*"), "entries")}
    assert e["good", 2] is None and e["tail", 2] == "the entry is cut off" and e["tail", 1] is None
    b = {r.cluster_id: r.error for r in rows(spark, str(tmp_path / "good"), "blobs")}
    assert b[0] is None and all("not supported" in b[i] for i in (1, 2, 3, 4)) and b[5]
    with pytest.raises(Exception, match="not supported|no page archive|go past"):
        rows(spark, str(tmp_path), "header", mode="failfast")


def test_zstd_only_on_request(spark, tmp_path):
    import zstandard

    payload = layout.pack_cluster([b"hello", b"world"], 1)[1:]
    path = write(tmp_path, "z", [content("a", 0, 1)], [bytes([5]) + zstandard.ZstdCompressor().compress(payload)])
    assert "not supported" in rows(spark, path, "blobs")[0].error
    assert [bytes(r.data) for r in rows(spark, path, "blobs", zstd="true")] == [b"hello", b"world"]


def test_archives_that_share_cluster_ids_keep_their_bytes(spark, tmp_path):
    for name in ("one", "two"):
        write(tmp_path, name, [content("a", 0, 0)], [layout.pack_cluster([name.encode()], 4)])
    e, b = (section(spark, str(tmp_path), s) for s in ("entries", "blobs"))
    assert {r.archive: bytes(r.data) for r in archive.with_data(e, b).collect()} == {"one": b"one", "two": b"two"}
    assert [r.archive for r in e.where("archive = 'two'").collect()] == ["two"]


def test_long_mime_list_and_unsorted_offsets(spark, tmp_path):
    mimes = [f"type/{'x' * 50}{i}" for i in range(200)]
    path = write(tmp_path, "m", [content("a", 0, 0, type_=199)], [layout.pack_cluster([b"x"], 1)], mimes=mimes)
    assert rows(spark, path, "entries")[0].mime_type == mimes[199]
    h = layout.Header(5, 0, "", 0, 3, 0, 0, 0, 0, None, None, 900)
    assert layout.cluster_ends([500, 100, 300], [500, 100, 300], h) == [899, 299, 499]


def test_xz_with_trailing_bytes():
    data = layout.pack_cluster([b"a", b"b"], 4) + b"rest"
    assert layout.unpack_cluster(data) == [b"a", b"b"] and lzma.decompress(data[1:-4])


def test_written_archives_read_back(spark, tmp_path):
    src = [("w", "A", f"p{i:02d}", f"t{i}", f"A/p{i - 1:02d}" if i % 5 == 4 else None, bytes([i]) * i) for i in range(40)] + [("w", "A", "zz", "", "A/nowhere", b"")]
    df = spark.createDataFrame(src, "archive string, namespace string, path string, title string, redirect_path string, data binary")
    assert archive.write_archives(df, str(tmp_path / "out")).first().entries == 41
    e, b = (section(spark, str(tmp_path / "out"), s) for s in ("entries", "blobs"))
    got = {r.path: (r.kind, bytes(r.data) if r.data is not None else None) for r in archive.with_data(e, b).collect()}
    assert got == {p: ("redirect", None) if to else ("content", d) for _, _, p, _, to, d in src}
    assert [r.path for r in archive.dangling(e).collect()] == ["zz"]
    assert section(spark, str(tmp_path / "out"), "clusters").agg(F.count("*")).first()[0] == 2


def test_clusters_in_any_order(spark, tmp_path):
    """Pointers that don't rise: blobs are whole whatever a partition reads of the list."""
    packed = [layout.pack_cluster([bytes([i]) * (50 + i)], 4 if i % 2 else 1) for i in range(7)]
    data = bytearray(layout.build([content(f"p{i}", i, 0) for i in range(7)], ["text/html"], packed))
    h = layout.header(io.BytesIO(bytes(data)))
    at = struct.unpack_from("<7Q", data, h.cluster_pos)
    order = [3, 0, 5, 1, 6, 2, 4]
    struct.pack_into("<7Q", data, h.cluster_pos, *[at[i] for i in order])
    (tmp_path / "mixed").write_bytes(data)
    for size in ("1", "2", "100"):
        got = {r.cluster_id: bytes(r.data) for r in rows(spark, str(tmp_path / "mixed"), "blobs", clustersPerPartition=size)}
        assert got == {k: bytes([i]) * (50 + i) for k, i in enumerate(order)}
        ends = {r.cluster_id: (r.start, r.end) for r in rows(spark, str(tmp_path / "mixed"), "clusters", clustersPerPartition=size)}
        assert ends == {k: (at[i], (at[i + 1] if i < 6 else h.checksum_pos) - 1) for k, i in enumerate(order)}
