"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and all runs in one process, a temporary one of the application."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("on a cluster, set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="mimiq-")
    return _OWN_DIRS[app]


#: Spark deletes the shuffle files of a query as it ends, instead of when the driver collects garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    What follows starts from the files: an executor lost later costs no
    recomputation of ``df``, and a nondeterministic step is settled. With ``tidy`` the
    shuffle files of the writing go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mimiq-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, "false")
    try:
        if tidy:
            spark.conf.set(_TIDY, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy:
            spark.conf.set(_TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables from ``materialize`` that nothing will read again; others are left alone."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            jvm, df._written_at = df.sparkSession._jvm, None
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
