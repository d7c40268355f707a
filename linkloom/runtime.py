"""Session settings and the shared folder in which multi-round operators keep their rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "linkloom", cores: str = "*", **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, adaptive execution, skew joins)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local, as in tests, a temporary folder is
    made and set; on a cluster without the setting this raises.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="linkloom-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df, written as a table into the shared folder and read back: its lineage ends there.

    Unlike cached blocks, the table outlives the loss of executors. It is deleted when the
    JVM of the driver ends, or earlier by forget().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/linkloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    table = spark.read.schema(df.schema).parquet(path)
    table._linkloom_path = path
    return table


def forget(table: DataFrame | None) -> None:
    """Delete a table of written() that nothing reads any more."""
    path = getattr(table, "_linkloom_path", None)
    if path:
        spark = table.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
