"""Session helpers: a local session for tests, and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once per application.

    Python workers then import it whatever their PYTHONPATH is.
    """
    sc = spark.sparkContext
    name = f"folioscope-{sc.applicationId}.zip"
    if any(name in str(x) for x in sc._python_includes):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="folioscope-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, name)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names of Hadoop's file systems that Arrow calls otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder that all executors share: that of spark.checkpoint.dir, or a temporary one where this machine is the whole cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = tempfile.mkdtemp(prefix="folioscope-scratch-")
        atexit.register(shutil.rmtree, _SCRATCH[app], ignore_errors=True)
    return "file://" + _SCRATCH[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(file system, path in it) for Arrow, by a path or URI; Hadoop's names for object stores are known too."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")
