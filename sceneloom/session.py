"""Session set-up shared by the tests, the bench and the registered queries."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", memory: str = "16g", shuffle_partitions: int = 8,
                  app: str = "sceneloom") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    used whenever it is set. Only a local master without one gets a scratch
    folder, since a machine-local folder would not outlive a lost executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder and read again.

    Like ``checkpoint()``, but nothing of the plan comes along: a checkpointed table keeps the
    constraints known of its columns, which pile up from round to round of an iteration.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes the files of checkpointed or written tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path is None:
            file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
            path = file.get() if file.isDefined() else None
        if path is not None:
            discard_folder(df.sparkSession, path)


def discard_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder written for a step that is done, wherever Spark's writers can put one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
