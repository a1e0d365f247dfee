"""Sessions, tables in the shared folder, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("percola")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all run in one process, a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share; a local one would not do for master {master}")
    at = f"file://{tempfile.gettempdir()}/percola-shared-{os.getuid()}"
    spark.conf.set("spark.checkpoint.dir", at)
    return at


_bases: list[str] = []
_tables: list[str] = []
_files: list[Path] = []


def clean(spark: SparkSession) -> None:
    """Delete every table and file that this process has staged. Results that still read them are lost, so call it last."""
    jvm = spark._jvm
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _files:
        _files.pop().unlink(missing_ok=True)
    while _bases:
        path = jvm.org.apache.hadoop.fs.Path(_bases.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_file(name: str) -> Path:
    """A new file of the driver's, under a name that no other has; clean() deletes it."""
    _files.append(Path(tempfile.mkdtemp(prefix="percola-")) / f"{name}-{uuid.uuid4().hex}")
    return _files[-1]


def shared_file(spark: SparkSession, name: str) -> tuple[Path, bool]:
    """A new file that clean() deletes, and whether executors see it: so where the shared folder is one of a file system, else the driver's."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    at = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    if at.getScheme() != "file":
        return local_file(name), False
    folder = Path(at.getPath()) / f"percola-{uuid.uuid4().hex}"
    folder.mkdir(parents=True)
    _bases.append(f"file://{folder}")
    return folder / name, True


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs now: it does so once the driver's JVM has collected their plans."""
    spark._jvm.System.gc()


class Staged:
    """Tables written to the shared folder: a written table cuts lineage and outlives executors. drop() deletes one early."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/percola-{uuid.uuid4().hex}"
        self._n = 0
        _bases.append(self.base)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def put(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        at = self.path(name)
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._staged_at = at
        return out

    def put_bucketed(self, df: DataFrame, name: str, by: str) -> DataFrame:
        """As put, in buckets of `by`, one for each shuffle partition: joins on it that follow don't move this side."""
        at = self.path(name)
        table = f"{name}_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.option("compression", "zstd").option("path", at).bucketBy(buckets, by).sortBy(by).saveAsTable(table)
        _tables.append(table)
        out = self.spark.table(table)
        out._staged_at = at
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._staged_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written by the driver through Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def ship(spark: SparkSession) -> None:
    """Give executors this package where they don't have it: once per application, through Spark's own file server."""
    sc = spark.sparkContext
    if str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_percola_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="percola-")) / "percola_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    sc.addPyFile(str(out))
    sc._percola_shipped = True
