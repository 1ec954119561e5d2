"""Session factory and the one place that decides where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "trailmill", cores: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": cores,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session names none (tests, one machine) a folder of this process is used;
    a cluster must name one, as its executors don't share a local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = os.environ.get("TRAILMILL_SHARED_DIR") or os.path.join(tempfile.gettempdir(), f"trailmill-{os.getpid()}")
    return f"file://{own}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    The result has no lineage, survives the loss of any executor, and is deleted when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._trailmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that `cut` returned, once nothing reads it any more."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(df._trailmill_path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Hand texts to Python workers in smaller Arrow batches than by default.

    A batch is held several times over (JVM, pipe, worker), so the default of 10,000 rows or
    64 MB is much for a column of whole documents.  The session's settings are lowered, since
    Spark reads them when a returned frame is planned; smaller ones stay.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nothing refers to any more.

    Spark deletes them when the driver collects the garbage, which a small heap may not do
    before a long job ends.
    """
    import gc
    import time

    for _ in range(2):  # what the first finds free may hold what the second then finds
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
