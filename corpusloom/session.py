"""Session set-up, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corpusloom", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that no path need be set on them."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        path = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom.zip")
        with zipfile.PyZipFile(path, "w") as z:
            z.writepy(os.path.dirname(os.path.abspath(__file__)))
        spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a test-data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir`` where set, else a private one (local tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-shared-" + spark.sparkContext.applicationId)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_written: dict[str, list[str]] = {}


def clean(spark: SparkSession) -> None:
    """Delete the tables that ``written`` left in the shared folder in this session; results that still read them end."""
    jvm = spark.sparkContext._jvm
    for path in _written.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as parquet to the shared folder and read it back.

    Survives the loss of any executor, unlike a cache or a local checkpoint, and is compressed and
    columnar, unlike ``checkpoint()``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, if the files they are read from make fewer partitions than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
