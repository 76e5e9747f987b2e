"""Session helpers: one place for the settings every operator assumes."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "tonekit") -> SparkSession:
    """Build (or reuse) a session configured the way the library expects.

    On a cluster the caller's own session is used instead; :func:`prepare`
    is what every entry point applies to it.
    """
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on; safe to call on any session.

    * naive timestamps are UTC (the corpus convention), so the session zone is pinned;
    * AQE is on, so joins against derived dimension tables are planned from runtime
      sizes (broadcast below the threshold, sort-merge with skew splitting above it).
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


#: Folders made for local sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A ``local[...]`` session that names none gets a fresh folder: driver and tasks are one
    process there. Anywhere else a folder of the driver alone would be lost to the executors,
    so a missing setting is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        # the setting belongs to the core and cannot be changed in a running session
        d = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tonekit-ckpt-")
        _LOCAL[spark.sparkContext.applicationId] = d
    spark.sparkContext.setCheckpointDir(d)
    return d


def stored(df, name: str = "table"):
    """``df`` written to the shared folder as Parquet and read again: it is computed once, and later
    plans know its true size."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df):
    """Reliable checkpoint of ``df`` into the shared checkpoint folder (never a
    local checkpoint): cuts the lineage of a table several branches read and survives
    the loss of the executors that computed it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
