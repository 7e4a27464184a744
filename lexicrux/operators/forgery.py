"""Signs of tampering in a document, from features of its pages and metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexicrux.functions.text import pdf_timestamp

# fixed values: weights of severities, and what producers of edited files call themselves, in the order they are tried
WEIGHTS = (("low", 5), ("medium", 20), ("high", 40))
PRODUCERS = (
    "photoshop", "gimp", "photopea", "ilovepdf", "smallpdf", "pdfescape", "sejda", "pdf-xchange editor", "foxit phantompdf", "foxit editor",
    "nitro pro", "microsoft: print to pdf", "microsoft print to pdf", "canva", "inkscape",
)
EDITS = ("FreeText", "Redact", "Stamp", "Caret", "StrikeOut")
SPARSE_TRAILER = 2048


def risk(findings: DataFrame, key: str) -> DataFrame:
    """key, score (0 to 100), level, findings and the first three signals by severity's name, descending."""
    weight = F.lit(0)
    for s, w in WEIGHTS:
        weight = F.when(F.col("severity") == s, w).otherwise(weight)
    f = findings.withColumn("w_", weight)
    g = f.groupBy(key).agg(F.least(F.sum("w_"), F.lit(100)).cast("int").alias("score"), F.bool_or(F.col("severity") == "high").alias("high_"), F.count_if(F.col("severity") == "medium").alias("medium_"), F.count("*").alias("findings"))
    level = F.when(F.col("high_") & ((F.col("score") >= 50) | (F.col("medium_") >= 1)), "high").when(F.col("high_") | (F.col("medium_") >= 2) | (F.col("score") >= 35), "medium").otherwise("low")
    return g.select(key, "score", level.alias("level"), "findings")


def font_outliers(pages: DataFrame, key: str, page: str, font: str) -> DataFrame:
    """Pages none of whose fonts is dominant (on 30 % of the document's pages and at least 2): key, page.

    pages: a row per document, page and font; documents of one page have none."""
    d = pages.select(key, page, font).distinct()
    n = d.groupBy(key).agg(F.count_distinct(page).alias("n_"))
    freq = d.groupBy(key, font).agg(F.count("*").alias("c_"))
    dominant = freq.join(n, key).where("n_ >= 2").withColumn("dom_", F.col("c_") >= F.greatest(F.lit(2.0), 0.30 * F.col("n_"))).select(key, font, "dom_")
    any_dominant = F.bool_or("dom_").over(Window.partitionBy(key))
    x = d.join(dominant.withColumn("any_", any_dominant), [key, font])
    return x.groupBy(key, page).agg(F.bool_or("dom_").alias("shared_"), F.first("any_").alias("any_")).where("any_ AND NOT shared_").select(key, page)


def odd_pages(pages: DataFrame, key: str, page: str, what: list[str]) -> DataFrame:
    """Pages that differ from the document's usual `what` (on 60 % of the pages and at least 2, the first seen of a tie),
    if they are few: at most a third, at least one. Documents of fewer than 3 pages have none."""
    freq = pages.groupBy(key, *what).agg(F.count("*").alias("c_"), F.min(page).alias("first_"))
    w = Window.partitionBy(key)
    usual = freq.withColumn("n_", F.sum("c_").over(w)).withColumn("r_", F.row_number().over(w.orderBy(F.desc("c_"), "first_"))).where("r_ = 1 AND n_ >= 3").where(F.col("c_") >= F.greatest(F.lit(2.0), 0.6 * F.col("n_")))
    usual = usual.where((F.col("n_") > F.col("c_")) & (F.col("n_") - F.col("c_") <= F.greatest(F.lit(1), F.floor(F.col("n_") / 3))))
    u = usual.select(key, *(F.col(c).alias(f"u_{c}") for c in what))
    differs = F.lit(False)
    for c in what:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"u_{c}"))
    return pages.join(u, key).where(differs).select(key, page)


def metadata_findings(meta: DataFrame, key: str) -> DataFrame:
    """signal and severity out of producer, creator, creation_date, mod_date (PDF dates), num_eof, has_prev, trailing."""
    tool = F.lower(F.concat_ws(" ", "producer", "creator"))
    made, changed = pdf_timestamp(F.col("creation_date")), pdf_timestamp(F.col("mod_date"))
    days = F.datediff(changed, made)
    rows = F.array(
        F.when(F.exists(F.array(*map(F.lit, PRODUCERS)), lambda p: F.contains(tool, p)), _finding("metadata.producer", F.lit("high"))),
        F.when(changed < made, _finding("metadata.dates_reversed", F.lit("medium"))),
        F.when(days >= 365, _finding("metadata.late_change", F.lit("low"))),
        F.when((F.col("num_eof") > 1) & F.col("has_prev"), _finding("incremental.updates", F.when(F.col("num_eof") <= 2, "medium").otherwise("high"))),
        F.when(F.col("trailing") >= SPARSE_TRAILER, _finding("incremental.trailing_bytes", F.lit("medium"))),
    )
    return meta.select(key, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("f")).select(key, "f.*")


def annotation_findings(pages: DataFrame, key: str) -> DataFrame:
    """Editing marks (column annots): high where something is redacted, else medium; a row per document."""
    hits = F.filter("annots", lambda a: a.isin(*EDITS))
    own = pages.withColumn("h_", hits).where(F.size("h_") > 0)
    return own.groupBy(key).agg(F.when(F.bool_or(F.array_contains("h_", "Redact")), "high").otherwise("medium").alias("severity")).select(key, F.lit("annotation.editing_artifacts").alias("signal"), "severity")


def byte_counts(content: Column) -> Column:
    """num_eof, has_prev and trailing bytes of a PDF's content."""
    s = F.decode(content, "ISO-8859-1")
    return F.struct(F.regexp_count(s, F.lit("%%EOF")).alias("num_eof"), s.rlike(r"/Prev\s+\d+").alias("has_prev"), F.length(F.regexp_extract(s, r"(?s)%%EOF\s*((?:(?!%%EOF).)*)$", 1)).alias("trailing"))


def _finding(signal: str, severity: Column) -> Column:
    return F.struct(F.lit(signal).alias("signal"), severity.alias("severity"))


# fixed values: when a pixel is the red of a seal, and the share of such pixels that makes a region
RED, OVER_OTHERS, RED_SHARE = 120, 60, 0.004


@F.pandas_udf(DoubleType())
def red_share(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Share of pixels that are strongly red, of rows of bytes in the order red, green, blue; null without a pixel."""

    def one(data: bytes | None) -> float | None:
        if data is None or len(data) < 3:
            return None
        p = np.frombuffer(data, np.uint8)[: len(data) // 3 * 3].reshape(-1, 3).astype(np.int16)
        return float(((p[:, 0] > RED) & (p[:, 0] - p[:, 1] > OVER_OTHERS) & (p[:, 0] - p[:, 2] > OVER_OTHERS)).mean())

    for s in parts:
        yield s.map(one).astype("float64")


def seal_pages(pages: DataFrame, key: str, page: str, pixels: str) -> DataFrame:
    """key, images (pages with pixels) and seal_pages, the numbers of pages with a red region."""
    red = F.col("red_") > RED_SHARE
    x = pages.select(key, page, red_share(F.col(pixels)).alias("red_"))
    return x.groupBy(key).agg(F.count("red_").cast("int").alias("images"), F.array_sort(F.collect_list(F.when(red, F.col(page)))).alias("seal_pages"))


def seal_findings(docs: DataFrame, key: str) -> DataFrame:
    """A light sign where pages carry images (column images, their number) but none a red region (seal_pages, their numbers)."""
    missing = (F.col("images") > 0) & (F.coalesce(F.size("seal_pages"), F.lit(0)) <= 0)
    return docs.where(missing).select(key, F.lit("seal.absent_low_confidence").alias("signal"), F.lit("low").alias("severity"))


def summarised(findings: DataFrame, key: str) -> DataFrame:
    """risk() of findings (key, signal, severity) with the three most severe signals, of equals by name."""
    weight = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    own = findings.withColumn("w_", -weight)
    # a document has few findings; of each only the signal's name is kept
    top = own.groupBy(key).agg(F.slice(F.transform(F.array_sort(F.collect_set(F.struct("w_", "signal"))), lambda x: x["signal"]), 1, 3).alias("top"))
    return risk(findings, key).join(top, key)
