"""Session settings and the shared work area."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators expect; every one can be overridden by the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", app: str = "helixframe", **conf: str) -> SparkSession:
    """A local session with the engine's defaults (clusters bring their own)."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a plain ``local`` session without the setting gets a temporary folder;
    on a cluster a missing setting is an error, for a machine-local folder would
    not survive the loss of an executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts lineage and pins rows whose producer must not run twice (sampled range
    bounds, run numbers).  The files go when the application ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size of the tables that ``df`` reads, without a job; None if a leaf's size is unknown (rows made by the driver)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if all(s < 1 << 60 for s in sizes) else None


def input_bytes(df: DataFrame) -> int:
    """``plan_bytes``, or the counted rows times the usual width of one where that is unknown."""
    size = plan_bytes(df)
    return df.count() * df._jdf.schema().defaultSize() if size is None else size


def partitions_for(df: DataFrame, bytes_each: int, size: int | None = None) -> int:
    """Partitions of about ``bytes_each`` for ``df``, at least the shuffle default; ``size`` if it is known already."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil((input_bytes(df) if size is None else size) / bytes_each))
