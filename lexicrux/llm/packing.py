"""Problem 8: items packed into containers of fixed capacity.

Bounded-space online packing: every partition keeps at most OPEN windows; an item goes into the fullest window that still
has room for it; when none has, the fullest window is emitted and a new one opened. Emitted and full windows are final. The
items of the windows that are open at a partition's end are merged, largest first and best fit, for FAN partitions at a
time: items of at least one token each, so that a task holds at most FAN * OPEN * capacity of them whatever the table.

Defined results: null and empty texts have size 0 and need no room, they all go to the first merged container of their
partitions; rows repeated are packed each; an item above the capacity is cut into full containers and a rest that is
packed like an item; no item at or under the capacity is cut. Container ids are stable for the same partitions of input."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicrux.llm.tokens import counts
from lexicrux.staging import stage

OPEN = 128
FAN = 16
CAPACITY = 2048


class Windows:
    """Open windows sorted by what is used of them, with what they hold."""

    def __init__(self, capacity: int, most: int = OPEN):
        self.capacity, self.most, self.open, self.made = capacity, most, [], 0

    def place(self, size: int) -> tuple[int, int]:
        """(window, window that is final now or -1) for an item of 1 to capacity."""
        i, done = bisect_left(self.open, (self.capacity - size + 1, -1)) - 1, -1
        if i >= 0:
            used, k = self.open.pop(i)
        else:
            used, k = 0, self.made
            self.made += 1
            if size < self.capacity and len(self.open) >= self.most:
                done = self.open.pop()[1]
        if used + size == self.capacity:
            return k, k
        insort(self.open, (used + size, k))
        return k, done


def pack(items: DataFrame, key: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of an item: key, piece_no from 1, pieces, first_token, tokens, container."""
    kind = dict(items.select(key).dtypes)[key]
    most = OPEN

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, w = TaskContext.get().partitionId(), Windows(capacity, most)
        held: dict[int, list[tuple]] = {}  # rows of the open windows
        keys = None

        def out(rows: list[tuple], open_: bool) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], keys), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(np.full(len(rows), part), pa.int32()), pa.array(cols[5], pa.int64()), pa.array(np.full(len(rows), open_))],
                ["key", "piece_no", "pieces", "first_token", "tokens", "part", "bin", "open"],
            )

        for batch in batches:
            keys, done = batch.column(0).type, []
            for name, size in zip(batch.column(0).to_pylist(), counts(batch.column(1)).tolist()):
                if size == 0:
                    done.append((name, 1, 1, 0, 0, -1))
                    continue
                pieces = -(-size // capacity)
                for no in range(pieces):
                    tokens = min(size - no * capacity, capacity)
                    k, final = w.place(tokens)
                    held.setdefault(k, []).append((name, no + 1, pieces, no * capacity, tokens, k))
                    if final >= 0:
                        done += held.pop(final)
            yield out(done, False)
        if held:
            yield out([r for rows in held.values() for r in rows], True)

    columns = ["key", "piece_no", "pieces", "first_token", "tokens"]
    fields = f"key {kind}, piece_no INT, pieces INT, first_token BIGINT, tokens BIGINT"
    placed = stage(items.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(online, f"{fields}, part INT, bin BIGINT, open BOOLEAN"))
    grp = F.floor(F.col("part") / FAN)
    name = F.when(F.col("bin") < 0, F.format_string("m%d-0", grp)).otherwise(F.format_string("p%d-%d", "part", "bin"))
    stay = placed.where("NOT open").select(*columns, name.alias("container"))
    again = placed.where("open").select(*columns, grp.alias("grp"))

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by([("tokens", "descending"), ("key", "ascending"), ("piece_no", "ascending")])
        w = Windows(capacity, 1 << 30)
        bins = np.fromiter((w.place(x)[0] for x in t.column("tokens").to_pylist()), np.int64, t.num_rows)
        return t.append_column("bin", pa.array(bins))

    merged = again.groupBy("grp").applyInArrow(merge, f"{fields}, grp BIGINT, bin BIGINT").select(*columns, F.format_string("m%d-%d", "grp", "bin").alias("container"))
    return stay.unionByName(merged).withColumnRenamed("key", key)


def p8_assigned(spark, d: str) -> DataFrame:
    return pack(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")


def p8_fill(spark, d: str) -> DataFrame:
    """How many containers there are and how full they are."""
    used = p8_assigned(spark, d).groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return used.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.round(F.avg("tokens") / CAPACITY, 4).alias("fill"))


def p8_kept(spark, d: str) -> DataFrame:
    """What must hold of the containers: all items and tokens are there once, none is cut that fits, none is overfull."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = stage(p8_assigned(spark, d))
    whole = got.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"), F.max("pieces").alias("pieces"), F.count_distinct("piece_no").alias("nos"))
    items = whole.agg(
        F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.expr("count_if(tokens > 2048) AS cut"), F.expr("count_if((tokens <= 2048 AND pieces > 1) OR rows <> pieces OR nos <> pieces) AS wrong")
    )
    lost = docs.join(got, "doc_id", "left_anti").agg(F.count("*").alias("lost"))
    full = got.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > CAPACITY).alias("overfull"))
    every = items.unionByName(lost, allowMissingColumns=True).unionByName(full, allowMissingColumns=True)
    return every.agg(*(F.sum(c).alias(c) for c in every.columns))


def p8_found(spark, d: str) -> DataFrame:
    """Texts that the packer had to cut."""
    return p8_assigned(spark, d).where("pieces > 1 AND piece_no = 1").select("doc_id")


QUERIES = {"p8_found": p8_found, "p8_assigned": p8_assigned, "p8_fill": p8_fill, "p8_kept": p8_kept}
SQL = {
    "p8_found": r"""
SELECT doc_id FROM documents
WHERE len(regexp_extract_all(text, '[^ \t\n]+')) > 2048
""",
    "p8_kept": r"""
WITH n AS (SELECT coalesce(len(regexp_extract_all(text, '[^ \t\n]+')), 0) AS n FROM documents)
SELECT count(*) AS items, CAST(sum(n) AS BIGINT) AS tokens, count(*) FILTER (n > 2048) AS cut, CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS overfull FROM n
""",
}
