"""SparkSession helpers: session defaults and lineage staging."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Session with the settings the library expects (UTC, AQE, no UI)."""
    b = SparkSession.builder.appName("mopup")
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    try:
        return spark.sparkContext.master.startswith("local")
    except Exception:  # pragma: no cover - Spark Connect has no SparkContext
        return False


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder of the cluster; on a local session with none
    configured, a private folder is created (tests and single-machine runs)."""
    sc = None
    try:
        sc = spark.sparkContext
        current = sc.getCheckpointDir()
        if current:
            return current
    except Exception:
        pass
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir and sc is not None:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if sc is not None and _is_local(spark):
        d = tempfile.mkdtemp(prefix="mopup-ckpt-", dir=os.environ.get("MOPUP_TMP", "/tmp"))
        sc.setCheckpointDir(d)
        return d
    return None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate files inside the cluster's checkpoint folder
    (shared storage), never a machine-local folder on a cluster."""
    import uuid
    base = checkpoint_dir(spark)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for intermediate files")
    return os.path.join(base, "mopup-scratch", f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, how: str = "checkpoint") -> DataFrame:
    """Materialise ``df`` once so that several later passes reuse it.

    ``checkpoint`` writes a Parquet copy to the cluster's shared folder and reads that:
    lineage is cut, lost executors do no harm, and later passes read only the columns they
    need.  Copies stay until the folder is cleared.  ``none`` returns ``df`` unchanged.
    """
    if how == "none":
        return df
    if how == "checkpoint":
        path = scratch_path(df.sparkSession, "stage")
        # any column names and types survive: positional names, the given ones put back
        names, plain = df.columns, [f"c{i}" for i in range(len(df.columns))]
        df.toDF(*plain).write.parquet(path)
        back = df.sparkSession.read.schema(df.toDF(*plain).schema).parquet(path)
        return back.toDF(*names)
    raise ValueError(f"unknown staging mode {how!r}")
