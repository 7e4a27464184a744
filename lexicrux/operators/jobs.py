"""Jobs as an append-only log of events, and outputs that are made once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STOPPED = "job was running when the server stopped"


def latest(log: DataFrame, key: str, seq: str, status: str) -> DataFrame:
    """key, status of its last event, number of events, first and last seq."""
    return log.groupBy(key).agg(F.max_by(status, seq).alias("status"), F.count("*").alias("events"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"))


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart: running jobs end in error, queued ones are queued again, others stay."""
    running = F.col("status") == "running"
    return jobs.withColumn("error", F.when(running, STOPPED).otherwise(F.col("error") if "error" in jobs.columns else F.lit(None))).withColumn("status", F.when(running, "error").otherwise(F.col("status")))


def to_do(inputs: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Inputs that have no output yet."""
    return inputs if force else inputs.join(done.select(key).distinct(), key, "left_anti")


def coverage(have: DataFrame, expected: DataFrame, key: str, item: str, total: str) -> DataFrame:
    """key, have, expected, percent and the missing items of 1..total."""
    own = have.select(key, item).distinct()
    every = expected.select(key, total, F.explode(F.sequence(F.lit(1), F.col(total))).alias(item))
    x = every.join(own.withColumn("here_", F.lit(1)), [key, item], "left")
    g = x.groupBy(key).agg(F.count("here_").alias("have"), F.first(total).cast("bigint").alias("expected"), F.array_sort(F.collect_list(F.when(F.col("here_").isNull(), F.col(item)))).alias("missing"))
    return g.withColumn("percent", F.round(100.0 * F.col("have") / F.col("expected"), 1))


def recent(jobs: DataFrame, at: str, key: str, most: int = 50) -> DataFrame:
    """The most recent jobs, latest first, ties by key."""
    return jobs.orderBy(F.desc(at), key).limit(most)
