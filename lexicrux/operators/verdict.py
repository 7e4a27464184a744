"""What all checks of a judgment come to, in one row per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overall(docs: DataFrame, key: str, tampering: DataFrame, existence: DataFrame, citations: DataFrame) -> DataFrame:
    """docs with the level and score of tampering (level, score), the status of existence (status), the counters of citations
    (total, valid, not_found, out_of_scope) and the flags that follow. A check that has no row for a document is skipped: it
    neither fails the others nor raises a flag."""
    t = tampering.select(key, F.col("level").alias("tampering"), F.col("score").alias("tampering_score"))
    e = existence.select(key, F.col("status").alias("existence"))
    c = citations.select(key, "total", "valid", "not_found", "out_of_scope")
    x = docs.select(key).join(t, key, "left").join(e, key, "left").join(c, key, "left")
    x = x.na.fill("skipped", ["tampering", "existence"])
    flags = F.array_compact(F.array(
        F.when(F.col("tampering").isin("medium", "high"), "tampering"), F.when(F.col("existence") == "found_partial", "existence_partial"), F.when(F.col("existence") == "not_found", "existence_not_found"),
        F.when(F.col("existence") == "error", "existence_error"), F.when(F.col("not_found") > 0, "citations_not_found"),
    ))
    return x.select(key, "tampering", "tampering_score", "existence", F.when(F.col("total").isNull(), "skipped").otherwise("checked").alias("citations"), "total", "valid", "not_found", "out_of_scope", flags.alias("flags"))
