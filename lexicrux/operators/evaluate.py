"""Predicted spans against annotated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_hits(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """label, tp: spans equal in document, label and place, one to one (repeats are paired in order)."""
    on = [key, "label", "start", "end"]
    number = lambda df: df.select(*on).withColumn("nth_", F.row_number().over(Window.partitionBy(*on).orderBy("start")))
    return number(gold).join(number(pred), [*on, "nth_"]).groupBy("label").agg(F.count("*").alias("tp"))


def overlap_hits(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """label, tp: greedily, each annotated span in order takes the first predicted one not taken that overlaps it."""
    span = F.struct("ord", "start", "end")
    g = gold.groupBy(key, "label").agg(F.array_sort(F.collect_list(span)).alias("g"))
    p = pred.groupBy(key, "label").agg(F.array_sort(F.collect_list(span)).alias("p"))

    def step(acc: Column, s: Column) -> Column:
        at = F.array_position(F.transform(acc["left"], lambda x: (x["start"] < s["end"]) & (x["end"] > s["start"])), True)
        rest = F.filter(acc["left"], lambda _, i: i != at - 1)
        return F.struct(F.when(at > 0, rest).otherwise(acc["left"]).alias("left"), (acc["tp"] + F.when(at > 0, 1).otherwise(0)).cast("int").alias("tp"))

    both = g.join(p, [key, "label"])
    tp = F.aggregate("g", F.struct(F.col("p").alias("left"), F.lit(0).alias("tp")), step, lambda acc: acc["tp"])
    return both.select("label", tp.alias("tp")).groupBy("label").agg(F.sum("tp").alias("tp"))


def prf(hits: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """label, tp, gold, pred, precision, recall, f1, per label and in all (micro)."""
    g, p = (df.groupBy("label").agg(F.count("*").alias(n)) for df, n in ((gold, "gold"), (pred, "pred")))
    per = g.join(p, "label", "full").join(hits, "label", "left").na.fill(0, ["gold", "pred", "tp"])
    every = per.unionByName(per.agg(F.sum("gold").alias("gold"), F.sum("pred").alias("pred"), F.sum("tp").alias("tp")).withColumn("label", F.lit("micro")))
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    pr, rc = div(F.col("tp"), F.col("pred")), div(F.col("tp"), F.col("gold"))
    return every.select("label", "tp", "gold", "pred", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(div(2 * pr * rc, pr + rc), 6).alias("f1"))


def split(rows: DataFrame, key: str, dev_share: float = 0.1) -> DataFrame:
    """rows with part: train or dev by a hash of the key, the same on every run and cluster; under 10 rows both are all."""
    bucket = F.conv(F.substring(F.sha1(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % 10_000
    if rows.limit(10).count() < 10:
        return rows.withColumn("part", F.lit("train")).unionByName(rows.withColumn("part", F.lit("dev")))
    return rows.withColumn("part", F.when(bucket < int(dev_share * 10_000), "dev").otherwise("train"))


def in_gold(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Predicted spans of the labels that were annotated at all."""
    return pred.join(gold.select("label").distinct(), "label", "left_semi")


def with_macro(report: DataFrame) -> DataFrame:
    """prf() with a row macro: the means over the labels, and the sums of their counts."""
    own = report.where("label <> 'micro'")
    mean = own.agg(*(F.sum(c).alias(c) for c in ("tp", "gold", "pred")), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")))
    return report.unionByName(mean.withColumn("label", F.lit("macro")))
