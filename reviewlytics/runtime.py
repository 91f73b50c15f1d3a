"""Session set-up, tables, and results that are computed once."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def session(app: str = "reviewlytics", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever they were started."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        stem = os.path.join(tempfile.mkdtemp(prefix="reviewlytics-"), "reviewlytics")
        spark.sparkContext.addPyFile(shutil.make_archive(stem, "zip", home, "reviewlytics"))
        _shipped.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core on a table that sits in few files or row groups.

    A table with at least as many scan partitions as there are cores, which is
    any large one, is returned as it is: its rows are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(cores, key)


_local_scratch: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only in local mode, as in tests, a temporary folder stands in for it when
    it is unset; it goes with the process. Elsewhere a missing one is an error:
    the driver and the executors would not see each other's files.
    """
    conf = spark.sparkContext.getConf()
    shared = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="reviewlytics-")
        atexit.register(shutil.rmtree, _local_scratch[app], ignore_errors=True)
    return _local_scratch[app]


def _settled_folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark).rstrip('/')}/settled/{spark.sparkContext.applicationId}"


def settle(df: DataFrame, name: str = "t") -> DataFrame:
    """Compute ``df`` once: write it to the shared folder and read it back.

    Unlike a cache this survives the loss of executors, and it cuts the
    lineage. The tables of a session lie in a folder of its own, which
    :func:`clear_scratch` deletes.
    """
    spark = df.sparkSession
    path = f"{_settled_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this session has settled, once the results that read it are written. Shared results are computed anew."""
    forget_settled()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_settled_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the files of shuffles that no DataFrame refers to any more deleted now, not when memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, limit: int):
    """Hand Python workers about ``limit`` bytes of rows at a time in what is run, or turned into an RDD, inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_measured: dict[tuple, int] = {}


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows in memory: their texts, and eight bytes per column.

    A settled table never changes, so its size is added up once; other tables
    are measured each time.
    """
    spark = df.sparkSession
    files, mine = df.inputFiles(), f"/settled/{spark.sparkContext.applicationId}/"
    key = (df.semanticHash(), *sorted(files)) if files and all(mine in f for f in files) else None
    if key not in _measured:
        size = F.lit(8 * len(df.columns)).cast("bigint")
        for field in df.schema.fields:
            if isinstance(field.dataType, T.StringType):
                size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        found = df.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0
        if key is None:
            return found
        _measured[key] = found
    return _measured[key]


BROADCAST_BYTES = 64 * 1024 * 1024


def lookup(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join many ``rows`` with a table that is usually small.

    ``small`` is broadcast when its measured size allows that. Otherwise both
    sides are shuffled and sorted, where adaptive execution splits hot keys.
    ``rows`` is never broadcast: it may be the product of an explode, whose
    size the optimizer underestimates.
    """
    if measured_bytes(small) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), on, how)
    return rows.join(small.hint("merge"), on, how)


_settled: dict[tuple, DataFrame] = {}


def settled_once(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """``settle(build())``, shared by all queries of a session on one folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _settled:
        _settled[key] = settle(build(), name)
    return _settled[key]


def forget_settled() -> None:
    """Make the next query compute its inputs again (used by the benchmark)."""
    _settled.clear()
