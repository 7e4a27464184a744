"""Problem 1: oversized texts cut into pieces under a limit.

Content-defined chunking. A rolling hash over the last WINDOW tokens marks landmarks; each cut is the first landmark
between a least and a most piece size, moved to the nearest natural boundary (section heading or blank line, line end,
sentence end) between these sizes. Cuts depend only on the text near them, so that an edit alters the pieces at it and
the few up to the next common cut.

Defined results: null and empty texts have no pieces; a text that fits has none either (it needs no cutting). A limit
that is null, or a table row repeated, adds nothing; a room below 1 counts as 1, an overlap of the room or more is cut to
room - 1. Text without any boundary is cut at the landmark, or at the most size."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexicrux.llm.tokens import spans
from lexicrux.staging import bounded

WINDOW = 8
#: Configurations are a small fixed table; more rows are refused.
MOST_CONFIGS = 1000
HEADING = re.compile(r"(?:NỘI DUNG|NHẬN ĐỊNH|XÉT THẤY|QUYẾT ĐỊNH|TUYÊN XỬ|\[\d+\])")
SENTENCE = np.array([ord(c) for c in ".;:!?…"], np.uint32)


def marks(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of tokens; rank of the boundary before each token (3 section, 2 line, 1 sentence, 0 none);
    rolling hash that ends with the token before it."""
    a, starts, ends = spans(text)
    n = len(starts)
    rank = np.zeros(n, np.int8)
    h = np.zeros(n, np.uint64)
    if n < 2:
        return starts, ends, rank, h
    rank[1:][np.isin(a[ends[:-1] - 1], SENTENCE)] = 1
    lines = np.concatenate([[0], np.cumsum(a == 10)])
    gap = lines[starts[1:]] - lines[ends[:-1]]
    rank[1:][gap == 1] = 2
    rank[1:][gap > 1] = 3
    for m in HEADING.finditer(text):
        i = int(np.searchsorted(starts, m.start()))
        if 0 < i < n and starts[i] == m.start():
            rank[i] = 3
    at = np.repeat(starts, np.diff(np.append(starts, len(a))))
    b = a[starts[0] :].astype(np.uint64)
    within = (np.arange(starts[0], len(a)) - at).astype(np.uint64)
    value = (b + np.uint64(0x9E37)) * (within * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xC2B2AE3D27D4EB4F))
    value[(b == 32) | (b == 9) | (b == 10)] = 0
    word = np.add.reduceat(value, starts - starts[0])
    word ^= word >> np.uint64(29)
    for k in range(WINDOW):
        h[k + 1 :] += (word[: n - k - 1] * np.uint64(0xBF58476D1CE4E5B9)) << np.uint64(k)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return starts, ends, rank, h >> np.uint64(20)


def cuts(n: int, ranks: dict[int, list[int]], landmarks: list[int], room: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges of the pieces of a text of n > room tokens."""
    out, begin, start = [], 0, 0
    while n - begin > room:
        hi = begin + room
        lo = min(hi, max(start + 1, start + (hi - start) // 3))
        k = bisect_left(landmarks, lo)
        target = landmarks[k] if k < len(landmarks) and landmarks[k] <= hi else hi
        cut, near = 0, (hi - lo) // 4
        for rank, reach in ((3, near), (2, near), (1, hi), (2, hi), (3, hi)):
            at = ranks[rank]
            i, j = bisect_left(at, max(lo, target - reach)), bisect_right(at, min(hi, target + reach))
            if i < j:
                k = bisect_left(at, target, i, j)
                cut = min((at[x] for x in (k - 1, k) if i <= x < j), key=lambda x: abs(x - target))
                break
        cut = cut or target
        out.append((begin, cut))
        start, begin = cut, max(begin + 1, cut - overlap)
    out.append((begin, n))
    return out


def split_pieces(texts: DataFrame, configs: DataFrame, key: str = "rec_no", text: str = "full_text", with_text: bool = True) -> DataFrame:
    """One row per piece: key, config_id, piece_no from 1, token and character range, shared tokens, and its text."""
    rooms = sorted(
        {
            (r.config_id, max(1, r.model_max_length - (r.special_tokens or 0)), max(0, r.overlap_tokens or 0))
            for r in bounded(configs.select("config_id", "model_max_length", "special_tokens", "overlap_tokens").where("config_id IS NOT NULL AND model_max_length IS NOT NULL"), MOST_CONFIGS, "tokenizer_config")
        }
    )
    kind = dict(texts.select(key).dtypes)[key]
    schema = f"`{key}` {kind}, config_id INT, piece_no INT, first_token INT, end_token INT, first_char INT, end_char INT, shared_tokens INT" + ", piece STRING" * with_text
    least = min((r for _, r, _ in rooms), default=0)
    key_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, parts = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts, ends, rank, h = marks(t)
                n = len(starts)
                if n <= least:
                    continue
                ranks = {r: np.flatnonzero(rank == r).tolist() for r in (1, 2, 3)}
                for config, room, overlap in rooms:
                    if n <= room:
                        continue
                    overlap = min(overlap, room - 1)
                    every = np.uint64(max(2, (room - overlap) // 4))
                    was = 0
                    for no, (i, j) in enumerate(cuts(n, ranks, np.flatnonzero(h % every == 0).tolist(), room, overlap), 1):
                        keys.append(k)
                        a, b = int(starts[i]), int(ends[j - 1])
                        rows.append((config, no, i, j, a, b, max(0, was - i)))
                        was = j
                        if with_text:
                            parts.append(t[a:b])
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), *(pa.array(c, pa.int32()) for c in cols), *([pa.array(parts, pa.string())] * with_text)],
                [key, "config_id", "piece_no", "first_token", "end_token", "first_char", "end_char", "shared_tokens", *(["piece"] * with_text)],
            )

    if not rooms:
        return texts.sparkSession.createDataFrame([], schema)
    # a text of more than `least` tokens has at least 2 * least + 1 characters: an exact filter that stays in the JVM
    long = texts.where(F.length(text) > 2 * least).select(F.col(key), F.col(text))
    return long.mapInArrow(run, schema)


def p1_pieces(spark, d: str) -> DataFrame:
    return split_pieces(spark.read.parquet(f"{d}/precedents.parquet"), spark.read.parquet(f"{d}/tokenizer_config.parquet"))


def p1_found(spark, d: str) -> DataFrame:
    """Texts that had to be cut: those of which the operator made a second piece."""
    pieces = split_pieces(spark.read.parquet(f"{d}/precedents.parquet"), spark.read.parquet(f"{d}/tokenizer_config.parquet"), with_text=False)
    return pieces.where("piece_no = 2").select("rec_no", "config_id")


def p1_kept(spark, d: str) -> DataFrame:
    """What must hold of the pieces, per configuration: every token is in them, none is too large, none is missing between two,
    and each shares as many tokens with the one before as asked for."""
    conf = spark.read.parquet(f"{d}/tokenizer_config.parquet").select("config_id", (F.col("model_max_length") - F.coalesce("special_tokens", F.lit(0))).alias("room"), F.coalesce("overlap_tokens", F.lit(0)).alias("overlap"))
    pieces = split_pieces(spark.read.parquet(f"{d}/precedents.parquet"), spark.read.parquet(f"{d}/tokenizer_config.parquet"), with_text=False)
    w = Window.partitionBy("rec_no", "config_id").orderBy("piece_no")
    x = pieces.join(F.broadcast(conf), "config_id").withColumn("before", F.lag("end_token").over(w))  # the table of configurations is fixed
    one = x.groupBy("config_id", "rec_no").agg(
        F.max("end_token").alias("tokens"), F.count_if(F.col("end_token") - F.col("first_token") > F.col("room")).alias("large"),
        F.count_if(F.coalesce(F.col("before") - F.col("first_token"), F.when(F.col("first_token") == 0, F.col("shared_tokens")).otherwise(-1)) != F.col("shared_tokens")).alias("gaps"),
        F.count_if(F.col("before").isNotNull() & (F.col("shared_tokens") != F.col("overlap"))).alias("wrong"),
    )
    return one.groupBy("config_id").agg(F.count("*").alias("texts"), *(F.sum(c).alias(c) for c in ("tokens", "large", "gaps", "wrong")))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_kept": p1_kept}
SQL = {
    "p1_kept": r"""
WITH n AS (SELECT len(regexp_extract_all(full_text, '[^ \t\n]+')) AS n FROM precedents)
SELECT config_id, count(*) AS texts, CAST(sum(n) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS large, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS wrong
FROM n JOIN tokenizer_config ON n > model_max_length - special_tokens GROUP BY config_id
""",
    "p1_found": r"""
SELECT p.rec_no, c.config_id FROM precedents p JOIN tokenizer_config c
ON len(regexp_extract_all(p.full_text, '[^ \t\n]+')) > c.model_max_length - c.special_tokens
""",
}
