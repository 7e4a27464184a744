"""Pairs of records out of pairs of classes of equal records.

The rows grow with the product of the sizes of both classes, as asked for; no task holds more than BLOCK by BLOCK of them:
members are spread over blocks of their class and every pair of blocks is a join key of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """rec_a < rec_b of every pair of records that the class pairs (rep_a, rep_b; equal ones for pairs within a class) stand for.

    members: k, rep, copies, one row per record. A record that stands in several classes comes out once with each partner."""
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    m = members.select("k", "rep", "copies", F.pmod(F.xxhash64(F.lit(3), "k"), blocks("copies")).cast("int").alias("block"))
    size = members.select("rep", blocks("copies").alias("n")).distinct()
    p = pairs.join(size.withColumnsRenamed({"rep": "rep_a", "n": "na"}), "rep_a").join(size.withColumnsRenamed({"rep": "rep_b", "n": "nb"}), "rep_b")
    p = p.withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    p = p.where((F.col("rep_a") != F.col("rep_b")) | (F.col("block_a") <= F.col("block_b"))).select("rep_a", "rep_b", "block_a", "block_b")
    side = lambda x: m.select(F.col("rep").alias(f"rep_{x}"), F.col("block").alias(f"block_{x}"), F.col("k").alias(x))
    both = p.join(side("a"), ["rep_a", "block_a"]).join(side("b"), ["rep_b", "block_b"]).where("a <> b")
    return both.select(F.least("a", "b").alias("rec_a"), F.greatest("a", "b").alias("rec_b")).distinct()
