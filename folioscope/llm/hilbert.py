"""Sharding along a Hilbert curve.

Several metadata dimensions of each row are quantised to a grid, rows are sorted by the index of their
cell on the Hilbert curve through that grid, and the order is cut into runs. Rows that are near each other
in every dimension lie near each other on the curve, so a run's range in each dimension is narrow and a
filter on any of them skips most shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from . import common


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each column of ``coords`` (dimensions x rows, values under 2**bits).

    The transposed form of the index is derived with exclusive ors and swaps from the high bit down
    (Skilling 2004), then its bits are interleaved. bits * dimensions must not exceed 63.
    """
    x = coords.astype(np.uint64).copy()
    n = len(x)
    if bits * n > 63:
        raise ValueError("the index must fit in 63 bits")
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(n):
            high = (x[i] & np.uint64(q)) != 0
            t = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def with_cells(rows: DataFrame, labels: list[str], bits: int) -> DataFrame:
    """``rows`` and, for label k, a grid coordinate ``_cell{k}`` that rises with the label: its rank among the distinct ones, scaled to the grid.

    Null is 0. While there are fewer labels than cells each has its own; so a range of cells is a range of labels, by which files are told
    apart. The distinct labels are ranked in parallel, and broadcast only if they are few.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), F.col(c).cast("string").alias("label")) for k, c in enumerate(labels)])).alias("x")
    distinct = rows.select(each).select("x.dim", "x.label").where("label is not null").distinct()
    ranked = common.materialize(common.global_rank(distinct, ["label"], within="dim", name="r"), "labels")
    sizes = ranked.groupBy("dim").agg(F.count("*").alias("n"))
    cells = ranked.join(sizes, "dim").select("dim", "label", F.expr(f"int(1 + r * {(1 << bits) - 1}L div greatest(n, {(1 << bits) - 1}L))").alias("cell"))
    few = ranked.count() <= common.BROADCAST_ROWS
    for k, c in enumerate(labels):
        own = cells.where(F.col("dim") == k).select(F.col("label").alias(f"_label{k}"), F.col("cell").alias(f"_own{k}"))
        rows = rows.join(F.broadcast(own) if few else own, F.col(c).cast("string") == F.col(f"_label{k}"), "left")
        rows = rows.withColumn(f"_cell{k}", F.coalesce(f"_own{k}", F.lit(0))).drop(f"_label{k}", f"_own{k}")
    return rows


def magnitude(c: Column, bits: int, steps: int = 10) -> Column:
    """A grid coordinate for a size: ``steps`` cells a doubling, the last cell open-ended; null is 0."""
    v = F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.floor(F.log2(v + 1) * steps), F.lit((1 << bits) - 1)).cast("int")


def shard_by_curve(rows: DataFrame, dims: dict[str, Column], shards: int, bits: int = 8, tie: list[str] | None = None) -> DataFrame:
    """Adds hilbert, shard and slot to ``rows``: runs of the curve order whose row counts differ by one at most.

    ``dims`` names the grid coordinates (ints under 2**bits). ``tie`` orders rows of one cell; together they
    should tell rows apart. Only the columns of ``rows`` are sorted and staged, so pass narrow rows and
    join the payload by key when the shards are written. Empty input gives empty output; repeated rows
    take a slot each. Where ``rows`` has a column of an added one's name, underscores are put behind the added name.
    """
    keep = rows.columns
    plain = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], *[d.alias(f"d{i}") for i, d in enumerate(dims.values())])
    fields = [StructField(f"c{i}", f.dataType) for i, f in enumerate(rows.schema.fields)]
    out = StructType([*fields, StructField("h", LongType())])
    schema = to_arrow_schema(out)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[len(keep) :]])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(hilbert_index(at, bits))], schema=schema)

    common.ship(rows.sparkSession)
    order = ["h", *(f"c{keep.index(c)}" for c in tie or keep)]
    ranked = common.global_rank(plain.mapInArrow(index, out), order, name="r")
    n = max(ranked.count(), 1)
    # run s starts at the least rank r with floor(r * shards / n) = s
    ranked = ranked.withColumn("shard", F.expr(f"int((r * {shards}L) div {n}L)"))
    slot = F.col("r") - F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    added = {"hilbert": F.col("h"), "shard": F.col("shard"), "slot": slot}
    return ranked.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[v.alias(common.free_name(k, keep)) for k, v in added.items()])


def write_shards(docs: DataFrame, placed: DataFrame, key: list[str], path: str, files: int | None = None) -> None:
    """Writes ``docs`` as one folder per shard, in slot order, so Parquet's ranges prune along every dimension.

    About ``files`` tasks (as many as the session's partitions) write; a shard is cut among several of them, in runs of slots, and its files'
    names sort like its slots. ``placed`` has a row of (key, shard, slot) for each of ``docs``; rows without one are left out, a repeated
    key meets every row of it, and null keys are equal. Where ``docs`` has a column shard or slot, underscores are put behind the written one's name.
    """
    names = [common.free_name(c, docs.columns) for c in ("shard", "slot")]
    right = placed.select(*[F.col(f"`{c}`").alias(f"_key{i}") for i, c in enumerate(key)], *[F.col(c).alias(f"_{c}") for c in ("shard", "slot")])
    on = F.lit(True)
    for i, c in enumerate(key):
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"_key{i}"))
    joined = docs.join(right, on).select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"_{c}").alias(n) for c, n in zip(("shard", "slot"), names)])
    spread = joined.repartitionByRange(files or common.shuffle_partitions(docs.sparkSession), *names).sortWithinPartitions(*names)
    spread.write.partitionBy(names[0]).parquet(path)


def op10_hilbert_sharding(spark, sf_dir: str, shards: int = 24) -> DataFrame:
    """All documents along the curve of language, source and size, cut into 24 runs of equal row counts.

    A null text has size 8, a null label the lowest coordinate; rows that tie go by checksum, size and id, and repeated rows take a slot each.
    """
    docs = common.table(spark, sf_dir, "documents")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "lang", "source")
    dims = {"lang": F.col("_cell0"), "source": F.col("_cell1"), "size": magnitude(F.col("size"), 8)}
    rows = with_cells(rows, ["lang", "source"], 8).drop("lang", "source")
    out = shard_by_curve(rows, dims, shards, tie=["text_crc32", "size", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _curve_sql(source: str, names: list[str], bits: int) -> str:
    """``hilbert_index`` as common table expressions over the table ``source`` with a coordinate in each column of ``names``; the last is named curve."""
    steps, last = [], source

    def step(**columns: str) -> None:
        nonlocal last
        steps.append(f"{source}{len(steps)} AS MATERIALIZED (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in columns.items())}) FROM {last})")
        last = f"{source}{len(steps) - 1}"

    first = names[0]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for x in names:
            t = f"CASE WHEN {x} & {q} <> 0 THEN 0 ELSE xor({first}, {x}) & {q - 1} END"
            flipped = f"xor({first}, CASE WHEN {x} & {q} <> 0 THEN {q - 1} ELSE xor({first}, {x}) & {q - 1} END)"
            step(**({first: flipped} if x == first else {first: flipped, x: f"xor({x}, {t})"}))
    for before, x in zip(names, names[1:]):
        step(**{x: f"xor({x}, {before})"})
    t = "0"
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t = f"xor({t}, CASE WHEN {names[-1]} & {q} <> 0 THEN {q - 1} ELSE 0 END)"
    step(**{x: f"xor({x}, {t})" for x in names})
    n = len(names)
    index = " + ".join(f"(({x} >> {b}) & 1) * {1 << (b * n + n - 1 - i)}" for b in range(bits) for i, x in enumerate(names))
    return ", ".join(steps) + f", curve AS (SELECT *, {index} AS hilbert FROM {last})"


_CRC = [0] * 256
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c

OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, lang, source, hex(encode(coalesce(text, ''))) AS x FROM documents
), r AS (
  SELECT doc_id, lang, source, CAST(length(x) // 2 + 8 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(x, '..'), lambda b: CAST('0x' || b AS BIGINT))),
      lambda crc, b: xor(crc >> 8, ({_CRC})[(xor(crc, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d
), l AS (
  SELECT 0 AS dim, lang AS label FROM documents WHERE lang IS NOT NULL UNION SELECT 1, source FROM documents WHERE source IS NOT NULL
), c AS (
  SELECT dim, label, CAST(1 + (row_number() OVER (PARTITION BY dim ORDER BY label) - 1) * 255 // greatest(count(*) OVER (PARTITION BY dim), 255) AS BIGINT) AS cell FROM l
), g AS (
  SELECT r.*, coalesce(a.cell, 0) AS x0, coalesce(b.cell, 0) AS x1, CAST(least(floor(ln(size + 1) / ln(2) * 10), 255) AS BIGINT) AS x2
  FROM r LEFT JOIN c a ON a.dim = 0 AND a.label = lang LEFT JOIN c b ON b.dim = 1 AND b.label = source
), {_curve_sql("g", ["x0", "x1", "x2"], 8)}, k AS (
  SELECT *, row_number() OVER (ORDER BY hilbert, text_crc32, size, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM curve
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 24 // n AS INTEGER) AS shard, place - (place * 24 // n * n + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM k
"""
