"""Cutting lineage into the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


_OWN: dict[str, str] = {}
#: Stages of each application that are still there.
_THERE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the cluster in spark.checkpoint.dir.

    Only where the setting is missing, in local mode (tests), a temporary folder of this process takes its place."""
    there = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if there:
        return there.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError(f"{KEY} must name a folder that all executors share")
    if sc.applicationId not in _OWN:
        own = tempfile.mkdtemp(prefix="lexicrux-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[sc.applicationId] = f"file://{own}"
    return _OWN[sc.applicationId]


def stage(df: DataFrame) -> DataFrame:
    """Write df as parquet under the shared folder and read it back: a lost executor costs nothing written before."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _THERE.setdefault(spark.sparkContext.applicationId, []).append(at)
    return spark.read.parquet(at)


def unstage(*dfs: DataFrame) -> None:
    """Drop what stage() wrote, once nothing reads it any more."""
    for df in dfs:
        for f in df.inputFiles()[:1]:
            path = f.rsplit("/", 1)[0]
            if "/stage-" in path:
                jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Drop all stages this application has written, once the results that read them are written themselves."""
    jvm, sc = spark._jvm, spark.sparkContext
    for at in _THERE.pop(sc.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def bounded(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table whose size has a stated bound; a larger one is refused, never cut short."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows")
    return rows
