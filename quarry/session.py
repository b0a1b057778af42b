"""Session and table helpers shared by the whole library."""

from __future__ import annotations

import contextlib
import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and single-machine runs; clusters bring their own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quarry")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table in few splits out to all cores; larger ones, with splits enough, stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Hand texts to Python in batches of few megabytes: whole documents can be long, and each batch
    lies in the JVM, on the way and in the worker at once. Smaller settings are left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, one machine) is a folder of our own used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        jvm_dir = sc._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
        if not found:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = "file://" + tempfile.mkdtemp(prefix="quarry-")
            sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Tables of one job in the shared folder: they cut lineage, and Spark knows their true sizes.

    Shuffle files behind a table go as soon as it is written.

    ``clear`` removes all but those that are named; a job calls it once its result is written.
    """

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark, self.path, self.number = spark, f"{root or shared_dir(spark)}/{name}-{uuid.uuid4().hex}", itertools.count()
        self.written: dict[int, str] = {}
        self.held: list[DataFrame] = []

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it again."""
        path = f"{self.path}/{next(self.number):04d}"
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.written[id(found)] = path
        self.held.append(found)
        return found

    def clear(self, *but: DataFrame) -> None:
        kept = {self.written[id(df)] for df in but}
        self.drop(*(df for df in self.held if self.written[id(df)] not in kept))

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later step reads."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.written.pop(id(df)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.held = [x for x in self.held if x is not df]
