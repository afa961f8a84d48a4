"""Archives as tables: writing them from entries, and the joins that follow their pointers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import file_system, ship
from ..sources import layout

PER_CLUSTER = 16


def put(folder: str, name: str, data: bytes) -> None:
    """Writes a file that is complete, or not there."""
    system, at = file_system(folder)
    system.create_dir(at, recursive=True)
    temporary = f"{at}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary, compression=None) as f:
        f.write(data)
    system.move(temporary, f"{at}/{name}")


def write_archives(entries: DataFrame, folder: str) -> DataFrame:
    """Writes (archive, namespace, path, title, redirect_path, data) as one file per archive; returns (archive, entries).

    An archive is one file and written by one task, so give archives of bounded size. Clusters of 16 blobs alternate between raw and
    xz. A redirect names the full path of its target; without one there it points to the id that stands for none. The first content
    entry is the main page.
    """
    ship(entries.sparkSession)

    def one(rows: pd.DataFrame) -> tuple[bytes, int]:
        rows = [r for r in rows.to_dict("records")]
        order = sorted(rows, key=lambda r: (r["namespace"] + "/" + r["path"]).encode())
        at = {r["namespace"] + "/" + r["path"]: i for i, r in enumerate(order)}
        out, blobs, main = [], [], None
        for i, r in enumerate(order):
            e = {"namespace": r["namespace"], "path": r["path"], "title": r["title"]}
            if r["redirect_path"] is not None:
                e |= {"type": layout.REDIRECT, "redirect_id": at.get(r["redirect_path"], layout.NONE32)}
            else:
                main = i if main is None else main
                e |= {"type": 0, "cluster_id": len(blobs) // PER_CLUSTER, "blob_id": len(blobs) % PER_CLUSTER}
                blobs.append(r["data"])
            out.append(e)
        groups = [blobs[i : i + PER_CLUSTER] for i in range(0, len(blobs), PER_CLUSTER)]
        clusters = [layout.pack_cluster(g, layout.XZ if i % 2 else 1) for i, g in enumerate(groups)]
        name = rows[0]["archive"]
        return layout.build(out, ["text/html"], clusters, main, str(uuid.uuid5(uuid.NAMESPACE_URL, name))), len(out)

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[pd.DataFrame]] = {}

        def flush(name: str) -> pd.DataFrame:
            data, n = one(pd.concat(held.pop(name)))
            put(folder, name, data)
            return pd.DataFrame({"archive": [name], "entries": [n]})

        for p in parts:
            for name, rows in p.groupby("archive", sort=False):
                for other in [x for x in held if x != name]:
                    yield flush(other)
                held.setdefault(name, []).append(rows)
        for name in list(held):
            yield flush(name)

    ordered = entries.repartition("archive").sortWithinPartitions("archive")
    return ordered.mapInPandas(write, "archive string, entries long")


def with_data(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Entries with their bytes; null for entries that have none."""
    b = blobs.where("blob_id is not null").select("archive", "cluster_id", "blob_id", "data")
    return entries.join(b, ["archive", "cluster_id", "blob_id"], "left")


def main_page(header: DataFrame, entries: DataFrame) -> DataFrame:
    """(archive, entry_id, full_path, title); null fields where an archive has no main page."""
    h = header.select(F.col("archive").alias("_archive"), "main_page")
    j = h.join(entries, (F.col("_archive") == entries["archive"]) & (F.col("main_page") == entries["entry_id"]), "left")
    return j.select(F.col("_archive").alias("archive"), "entry_id", "full_path", "title")


def titles_in_order(titles: DataFrame, entries: DataFrame) -> DataFrame:
    """(archive, title_rank, entry_id, title)."""
    return titles.join(entries.select("archive", "entry_id", "title"), ["archive", "entry_id"]).select("archive", "title_rank", "entry_id", "title")


def each_title(titles: DataFrame, call: Callable[[str, int, int], str | None]) -> DataFrame:
    """(archive, title_rank, entry_id, result): calls ``call(archive, title_rank, entry_id)`` for each title, where the titles are.

    Titles of a partition come in their order; a partition of the ``titles`` section is one range of one archive.
    """
    ship(titles.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(result=[call(*row) for row in p.itertuples(index=False, name=None)])

    return titles.select("archive", "title_rank", "entry_id").mapInPandas(run, "archive string, title_rank long, entry_id long, result string")


def dangling(entries: DataFrame) -> DataFrame:
    """Redirects to ids that no entry has; content entries of no known cluster are left to the caller's anti joins."""
    ids = entries.select("archive", F.col("entry_id").alias("redirect_id"))
    return entries.where("kind = 'redirect'").join(ids, ["archive", "redirect_id"], "left_anti")


def with_display_title(entries: DataFrame) -> DataFrame:
    """Adds display_title: the title, or the path where it is empty."""
    return entries.withColumn("display_title", F.coalesce(F.nullif("title", F.lit("")), F.col("path")))
