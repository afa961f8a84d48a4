"""What the corpus operators share: staged tables, global ranks, connected components.

Staged tables go to the folder in ``spark.checkpoint.dir``, which all executors share, so a job goes
on after executors are lost. Where that setting is absent and the master is this machine alone, a
temporary folder serves.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.session import ship, table

__all__ = ["arrow_type", "components", "discard", "drop_at_exit", "free_name", "global_rank", "lean", "make", "materialize", "new_path", "to_batch", "ship", "shuffle_partitions", "stage", "table"]

_LOCAL: dict[str, str] = {}
#: A list of small rows is broadcast up to this length, and joined by shuffle beyond.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables, as the session names it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="folioscope-staged-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def make(spark: SparkSession, path: str) -> None:
    """Makes a folder, if it isn't there, that is deleted when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    drop_at_exit(spark, path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder that exists now deleted when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a staged table that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Spark's setting by which a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and reads it back; returns its place too.

    Lineage ends here, and later passes see the same rows. What was shuffled for it is of no more use and goes at once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The staged table of ``stage`` alone."""
    return stage(df, name, compression)[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it until no taken name (in any case) is the same."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    """Null-safe equality over ``cols``."""
    on = F.lit(True)
    for c in cols:
        on = on & a[c].eqNullSafe(b[c])
    return on


def global_rank(df: DataFrame, order: list[str], within: str | None = None, name: str = "rank") -> DataFrame:
    """Adds ``name``: the row's place (from 0) in ``order``, over the table or within each value of ``within``.

    Range partitioning sorts in parallel; a prefix sum over one small row per partition (and value of
    ``within`` in it) turns local places into global ones, so no task ever holds a whole group. The
    sorted rows are staged, because a range partitioning drawn twice may cut elsewhere. ``order`` should
    tell all rows apart; rows that tie in all of it are adjacent, in any order.
    """
    spark = df.sparkSession
    keys = ([within] if within else []) + list(order)
    ranged = df.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    mask = (1 << 33) - 1
    staged = materialize(
        ranged.withColumn("_id", F.monotonically_increasing_id()).withColumns({"_pid": F.shiftright("_id", 33), "_local": F.col("_id").bitwiseAND(F.lit(mask))}).drop("_id"),
        "ranked",
    )
    group = ([within] if within else []) + ["_pid"]
    parts = staged.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_local").alias("_first"))
    w = (Window.partitionBy(within) if within else Window.partitionBy()).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts, "parts")
    offsets = parts.select(*group, (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_shift"))
    right = offsets.select(*[F.col(c).alias(f"r_{c}") for c in group], "_shift")
    on = F.lit(True)
    for c in group:
        on = on & (F.col(c).eqNullSafe(F.col(f"r_{c}")) if c == within else F.col(c) == F.col(f"r_{c}"))
    if parts.count() <= BROADCAST_ROWS:  # one row per partition, and per value of ``within`` in it
        right = F.broadcast(right)
    return staged.join(right, on).withColumn(name, F.col("_local") + F.col("_shift")).drop("_pid", "_local", "_shift", *[f"r_{c}" for c in group])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b: long): (node, root), root the least node reachable.

    Alternates large-star and small-star steps; each is a minimum per node (combined before the
    shuffle) and a join, whose hot nodes adaptive execution splits. Every round is staged and the loop
    ends when a round changes nothing. Nodes without edges don't appear.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, name)
    before = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a")
        small = star.select(F.col("b").alias("a"), F.col("m").alias("b")).union(star.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = materialize(small, name)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())


def arrow_type(schema: str) -> pa.Schema:
    """An Arrow schema from a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def to_batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch from Python lists."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def release() -> None:
    """Gives back to the system what this process has freed: neither malloc nor Arrow's pool does so by itself."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], tokens: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, so that a worker holds no memory of its earlier tasks.

    Spark uses its Python workers again, for other stages too. Loaded tokenizers go unless the task needs ``tokens``.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = sys.modules.get("folioscope.llm.wordbpe")
        if loaded is not None and loaded._LOADED and not tokens:
            loaded._LOADED.clear()
            release()
        try:
            yield from run(batches)
        finally:
            release()

    return task
