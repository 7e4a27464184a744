"""Job states kept by a stream: events in, one row per change out, the same event twice without effect."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "job_id STRING, status STRING, seq BIGINT, events BIGINT"
STATE = "status STRING, seq BIGINT, events BIGINT"
#: What may follow what; another step is left out, as one that comes late or twice.
NEXT = {None: {"queued", "running", "done", "error"}, "queued": {"running", "done", "error"}, "running": {"done", "error", "queued"}, "done": set(), "error": {"queued"}}


def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, seq, events = state.get if state.exists else (None, -1, 0)
    rows = pd.concat(list(parts), ignore_index=True).sort_values("seq", kind="stable")
    before = status, seq
    for s, n in zip(rows["status"], rows["seq"]):
        if n > seq and s in NEXT[status]:
            status, seq, events = s, int(n), events + 1
    if (status, seq) != before:
        state.update((status, seq, events))
        yield pd.DataFrame([{"job_id": key[0], "status": status, "seq": seq, "events": events}])


def job_states(events: DataFrame) -> DataFrame:
    """events: a stream of job_id, status, seq."""
    return events.groupBy("job_id").applyInPandasWithState(advance, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def advanced(before: Column, steps: Column) -> Column:
    """advance() as an expression: a job's status, seq and events after steps (seq, status) sorted by seq."""

    def step(acc: Column, s: Column) -> Column:
        follows = reduce(lambda a, b: a | b, (acc["status"].eqNullSafe(F.lit(k)) & s["status"].isin(*sorted(v)) for k, v in NEXT.items() if v))
        new = F.struct(s["status"].alias("status"), s["seq"].alias("seq"), (acc["events"] + 1).alias("events"))
        return F.when((s["seq"] > acc["seq"]) & follows, new).otherwise(acc)

    begun = F.struct(F.lit(None).cast("string").alias("status"), F.lit(-1).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("events"))
    return F.aggregate(steps, F.coalesce(before, begun), step)


def log_states(events: DataFrame, target: str, checkpoint: str):
    """The rows of job_states under target/batch=N, for any number of jobs: no Python for each; gives the finished query.

    What is there of earlier batches is the state; a batch that is repeated replaces its own rows."""

    def put(batch: DataFrame, no: int) -> None:
        rows = batch.select("job_id", F.struct("seq", "status").alias("step"), F.lit(None).cast("struct<seq:bigint,status:string,events:bigint>").alias("was"))
        if no:
            known = batch.sparkSession.read.schema(f"{OUT}, batch BIGINT").parquet(target).where(F.col("batch") < no)
            rows = rows.unionByName(known.select("job_id", F.lit(None).cast("struct<seq:bigint,status:string>").alias("step"), F.struct("seq", "status", "events").alias("was")))
        # seq grows with each change, so that the greatest row of a job is its last
        own = rows.groupBy("job_id").agg(F.max("was").alias("was"), F.sort_array(F.collect_list("step")).alias("steps"))
        was = F.when(F.col("was").isNotNull(), F.struct("was.status", "was.seq", "was.events"))
        new = own.select("job_id", "was", advanced(was, F.col("steps")).alias("now")).where("now.seq > coalesce(was.seq, -1)")
        new.select("job_id", "now.*").write.mode("overwrite").parquet(f"{target}/batch={no}")

    q = events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return q


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, form: str = "parquet"):
    """Take every file under source into target once, over any number of runs; gives the finished query."""
    stream = spark.readStream.schema(schema).format(form).load(source)
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    q.awaitTermination()
    return q
