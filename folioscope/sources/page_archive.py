"""The ``pagearchive`` data source: one or many archives as tables.

    spark.dataSource.register(PageArchive)
    spark.read.format("pagearchive").option("section", "entries").load("/folder/*.archive")

Sections: header, mime, paths, titles, entries, clusters, blobs. A path may be a file, a folder or a pattern. Entries and clusters
are read in ranges of ids, one partition each, whatever archive they are in. Bad bytes give rows with an error text
(``mode`` permissive, the default) or fail the read (``mode`` failfast). Filters on full_path (equality, prefix) narrow
the ranges by binary search in the sorted path list; filters on archive drop whole files.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from . import layout

SCHEMAS = {
    "header": "archive string, major int, minor int, uuid string, entry_count long, cluster_count long, path_pos long, title_pos long, cluster_pos long, mime_pos long, main_page long, layout_page long, checksum_pos long, error string",
    "mime": "archive string, mime_idx long, mime_type string",
    "paths": "archive string, entry_id long, offset long",
    "titles": "archive string, title_rank long, entry_id long",
    "entries": "archive string, entry_id long, offset long, type int, kind string, namespace string, path string, full_path string, title string, mime_type string, cluster_id long, blob_id long, redirect_id long, error string",
    "clusters": "archive string, cluster_id long, start long, end long, compression short",
    "blobs": "archive string, cluster_id long, blob_id long, compression short, data binary, error string",
}


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int


def _files(path: str) -> list[str]:
    """The archives that a path names."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        from pyarrow import fs

        from ..session import file_system

        system, at = file_system(path)
        info = system.get_file_info(at)
        root = path[: len(path) - len(at)]
        if info.type == fs.FileType.Directory:
            return sorted(root + x.path for x in system.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File)
        return [path]
    if os.path.isdir(path):
        path = os.path.join(path, "*")
    return sorted(p for p in glob.glob(path) if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_")))


class Reader(DataSourceReader):
    def __init__(self, section: str, path: str, options: dict):
        self.section, self.path = section, path
        self.strict = options.get("mode", "permissive").lower() == "failfast"
        self.zstd = str(options.get("zstd", "false")).lower() == "true"
        self.rows = int(options.get("entriesperpartition", 50_000))
        self.clusters = int(options.get("clustersperpartition", 256))
        self.archives: set[str] | None = None
        self.exact: bytes | None = None
        self.prefix: bytes | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("archive",):
                self.archives = {f.value} if self.archives is None else self.archives & {f.value}
            elif self.section == "entries" and isinstance(f, EqualTo) and f.attribute == ("full_path",):
                self.exact = f.value.encode()
            elif self.section == "entries" and isinstance(f, StringStartsWith) and f.attribute == ("full_path",):
                self.prefix = f.value.encode()
            yield f  # ranges are only narrowed; Spark still filters the rows

    def partitions(self) -> list[Range]:
        out = []
        for path in _files(self.path):
            if self.archives is not None and os.path.basename(path) not in self.archives:
                continue
            try:
                with layout.open_uri(path) as f:
                    h = layout.header(f)
                    total = {"header": 1, "mime": 1, "clusters": h.cluster_count, "blobs": h.cluster_count}.get(self.section, h.entry_count)
                    low = 0
                    wanted = self.exact if self.exact is not None else self.prefix
                    if wanted is not None:
                        low, total = self._narrow(f, h, wanted, total)
            except (layout.ArchiveError, OSError):
                if self.strict:
                    raise
                if self.section == "header":
                    out.append(Range(path, 0, 1))
                continue
            size = self.clusters if self.section in ("clusters", "blobs") else self.rows
            out += [Range(path, a, b) for a, b in layout.ranges(total, size, low)]
        return out or [Range("", 0, 0)]

    def _narrow(self, f, h: layout.Header, wanted: bytes, total: int) -> tuple[int, int]:
        """The id range that can hold the wanted paths; all ids where an entry on the way can't be read or the list isn't sorted there."""
        try:
            low, high = layout.search_path(f, h, wanted), layout.search_path(f, h, wanted, right=True)
        except layout.ArchiveError:
            return 0, total
        return (low, high) if low <= high else (0, total)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return

        names = _ARROW[self.section]
        archive = os.path.basename(part.path)
        batch: list[tuple] = []
        size = 0
        with layout.open_uri(part.path) as f:
            for row in getattr(self, "_" + self.section)(f, part):
                batch.append((archive, *row))
                size += len(row[3] or b"") if self.section == "blobs" else 200
                if size > 8 << 20:
                    yield _batch(batch, names)
                    batch, size = [], 0
        if batch:
            yield _batch(batch, names)

    def _fail(self, e: Exception) -> str:
        if self.strict:
            raise e
        return str(e)

    def _header(self, f, part: Range) -> Iterator[tuple]:
        try:
            h = layout.header(f)
            yield (h.major, h.minor, h.uuid, h.entry_count, h.cluster_count, h.path_pos, h.title_pos, h.cluster_pos, h.mime_pos, h.main_page, h.layout_page, h.checksum_pos, None)
        except layout.ArchiveError as e:
            yield (None,) * 12 + (self._fail(e),)

    def _mime(self, f, part: Range) -> Iterator[tuple]:
        try:
            yield from enumerate(layout.mime_list(f, layout.header(f)))
        except layout.ArchiveError as e:
            self._fail(e)

    def _paths(self, f, part: Range) -> Iterator[tuple]:
        yield from zip(range(part.first, part.last), layout.pointers(f, layout.header(f).path_pos, part.first, part.last - part.first, 8))

    def _titles(self, f, part: Range) -> Iterator[tuple]:
        yield from zip(range(part.first, part.last), layout.pointers(f, layout.header(f).title_pos, part.first, part.last - part.first, 4))

    def _entries(self, f, part: Range) -> Iterator[tuple]:
        h = layout.header(f)
        try:
            mimes = layout.mime_list(f, h)
        except layout.ArchiveError as e:
            self._fail(e)
            mimes = []
        for i, offset in zip(range(part.first, part.last), layout.pointers(f, h.path_pos, part.first, part.last - part.first, 8)):
            try:
                e = layout.entry(f, offset)
                mime = mimes[e["type"]] if e["kind"] == "content" and e["type"] < len(mimes) else None
                yield (i, offset, e["type"], e["kind"], e["namespace"], e["path"], layout.full_path(e), e["title"], mime, e["cluster_id"], e["blob_id"], e["redirect_id"], None)
            except (layout.ArchiveError, OSError) as e:
                yield (i, offset) + (None,) * 10 + (self._fail(e),)

    def _spans(self, f, part: Range, exact: bool) -> Iterator[tuple[int, int, int]]:
        """(id, start, end) of the range's clusters. Unless ``exact``, only the range's own pointers and the next one are read, if they
        rise: where the list as a whole doesn't, an end may then lie behind another cluster, which does no harm to blobs."""
        h = layout.header(f)
        upto = min(part.last + 1, h.cluster_count)
        near = layout.pointers(f, h.cluster_pos, part.first, upto - part.first, 8)
        mine = near[: part.last - part.first]
        rising = all(a < b for a, b in zip(near, [*near[1:], h.checksum_pos]))
        starts = near if rising and not exact else layout.pointers(f, h.cluster_pos, 0, h.cluster_count, 8)
        yield from zip(range(part.first, part.last), mine, layout.cluster_ends(mine, starts, h))

    def _clusters(self, f, part: Range) -> Iterator[tuple]:
        for i, start, end in self._spans(f, part, True):
            yield (i, start, end, layout.read_at(f, start, 1)[0])

    def _blobs(self, f, part: Range) -> Iterator[tuple]:
        for i, start, end in self._spans(f, part, False):
            kind = None
            try:
                data = layout.read_at(f, start, end - start + 1)
                kind = data[0]
                for b, blob in enumerate(layout.unpack_cluster(data, self.zstd)):
                    yield (i, b, kind, blob, None)
            except (layout.ArchiveError, OSError, IndexError) as e:
                yield (i, None, kind, None, self._fail(e if isinstance(e, layout.ArchiveError) else layout.ArchiveError(str(e))))


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "short": pa.int16(), "binary": pa.binary()}
_ARROW = {s: pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ddl.split(", ")]) for s, ddl in SCHEMAS.items()}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class PageArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagearchive"

    def _section(self) -> str:
        section = self.options.get("section", "entries").lower()
        if section not in SCHEMAS:
            raise ValueError(f"section is one of {', '.join(SCHEMAS)}")
        return section

    def schema(self) -> str:
        return SCHEMAS[self._section()]

    def reader(self, schema) -> Reader:
        return Reader(self._section(), self.options["path"], dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known, with its filters pushed down."""
    spark.dataSource.register(PageArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def section(spark: SparkSession, path: str, name: str, **options: str) -> DataFrame:
    """One section of the archives at a path."""
    from ..session import ship

    ship(spark)
    register(spark)
    return spark.read.format("pagearchive").options(section=name, **options).load(path)
