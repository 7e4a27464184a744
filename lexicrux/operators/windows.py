"""Tokens with offsets, BIO tags, chunks and windows over token positions."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

TOKEN = re.compile(r"\w+|[^\w\s]")
WINDOW, STRIDE = 200, 150
#: Tokens after which a sentence may end; one token each, also inside numbers.
BREAKS = (".", ";", ":", "?", "!")


@F.pandas_udf(ArrayType(StructType([StructField("token", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])))
def tokens_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda t: [{"token": m[0], "start": m.start(), "end": m.end()} for m in TOKEN.finditer(t or "")])


def tokenized(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, tok from 0, token, start, end."""
    return docs.select(key, F.posexplode(tokens_of(F.col(text))).alias("tok", "t")).select(key, "tok", "t.*")


def bio_encode(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """tokens with a tag: B on a span's first token, I on its others, O elsewhere; of overlapping spans the later one.

    spans: key, ord, label, start, end. A range join within a document, then one row a token again."""
    s = spans.select(key, "ord", "label", F.col("start").alias("s0"), F.col("end").alias("s1"))
    hit = tokens.join(s, [key]).where((F.col("start") < F.col("s1")) & (F.col("end") > F.col("s0")))
    first = F.row_number().over(Window.partitionBy(key, "ord").orderBy("tok")) == 1
    tag = hit.withColumn("tag", F.concat(F.when(first, F.lit("B-")).otherwise(F.lit("I-")), "label")).groupBy(key, "tok").agg(F.max_by("tag", "ord").alias("tag"))
    return tokens.join(tag, [key, "tok"], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))


def bio_decode(tagged: DataFrame, key: str) -> DataFrame:
    """key, ord, label, start, end of the tagged spans: B opens; I goes on with the same label, else opens as well.

    A column score, where there, comes out as its mean, rounded to 4."""
    w = Window.partitionBy(key).orderBy("tok")
    t = tagged.withColumn("kind", F.substring("tag", 1, 1)).withColumn("label", F.when(F.col("tag") != "O", F.substring("tag", 3, 1000)))
    goes_on = (F.col("kind") == "I") & F.col("label").eqNullSafe(F.lag("label").over(w))
    t = t.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(w)).where("kind <> 'O'")
    score = [F.round(F.avg("score"), 4).alias("score")] if "score" in tagged.columns else []
    out = t.groupBy(key, "run").agg(F.first("label").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), *score)
    return out.withColumn("ord", (F.row_number().over(Window.partitionBy(key).orderBy("run")) - 1).cast("int")).drop("run")


def chunk_ranges(tags: Column, size: int) -> Column:
    """Ranges of about `size` tags; a range goes on while the tag after it is an I."""
    n = F.size(tags)
    pair = lambda a, b: F.struct(a.cast("int").alias("lo"), b.cast("int").alias("hi"))
    none = F.array().cast("array<struct<lo:int,hi:int>>")

    def step(acc: Column, i: Column) -> Column:
        full = (i - acc["lo"] >= size) & ~F.startswith(F.get(tags, i), F.lit("I-"))
        return F.struct(F.when(full, i).otherwise(acc["lo"]).cast("int").alias("lo"), F.when(full, F.array_append(acc["out"], pair(acc["lo"], i))).otherwise(acc["out"]).alias("out"))

    begun = F.struct(F.lit(0).alias("lo"), none.alias("out"))
    out = F.aggregate(F.sequence(F.lit(0), n - 1), begun, step, lambda acc: F.array_append(acc["out"], pair(acc["lo"], n)))
    return F.when(n > 0, out).otherwise(none)


def sliding(n: Column, window: int = WINDOW, stride: int = STRIDE) -> Column:
    """Starts of windows over n tokens: the first window that reaches the end is the last."""
    last = F.greatest(F.lit(0), F.ceil((n - window) / stride)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda k: (k * stride).cast("int"))
    return F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))


def sentence_ends(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, ends: the tokens of a text and the places after those a sentence may end with; never more tokens than one text's at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends = [], []
            for t in batch.column(1):
                tokens = TOKEN.findall(t.as_py() or "")
                n.append(len(tokens))
                ends.append([i for i, x in enumerate(tokens, 1) if x in BREAKS])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(ends, pa.list_(pa.int32()))], ["k", "n", "ends"])

    out = StructType([StructField("k", docs.schema[key].dataType), StructField("n", IntegerType()), StructField("ends", ArrayType(IntegerType()))])
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, out).withColumnRenamed("k", key)


def windows_to_ends(n: Column, ends: Column, window: int = WINDOW, stride: int = STRIDE) -> Column:
    """Windows over n tokens that go on to the next sentence end, at most window + (window - stride) tokens, and overlap by window - stride."""
    over = window - stride
    pair = lambda a, b: F.struct(a.cast("int").alias("lo"), b.cast("int").alias("hi"))
    none = F.array().cast("array<struct<lo:int,hi:int>>")

    def step(acc: Column, ends: Column) -> Column:
        lo = acc["lo"]
        target, cap = F.least(lo + window, n), F.least(lo + window + over, n)
        hi = F.coalesce(F.array_min(F.filter(ends, lambda e: (e >= target) & (e <= cap))), cap)
        done = hi >= n
        out = F.array_append(acc["out"], pair(lo, F.when(done, n).otherwise(hi)))
        new = F.struct(F.greatest(lo + 1, hi - over).cast("int").alias("lo"), out.alias("out"), done.alias("done"))
        return F.when(acc["done"], acc).otherwise(new)

    begun = F.struct(F.lit(0).alias("lo"), none.alias("out"), F.lit(False).alias("done"))
    # every step gets the sentence ends as its element, so that they are computed once
    out = F.aggregate(F.array_repeat(ends, (n / stride).cast("int") + 2), begun, step, lambda acc: acc["out"])
    return F.when(n == 0, none).when(n <= window, F.array(pair(F.lit(0), n))).otherwise(out)


def sentence_windows(tokens: Column, window: int = WINDOW, stride: int = STRIDE) -> Column:
    """windows_to_ends of an array of tokens."""
    ends = F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(*BREAKS), i + 1)), lambda x: x.isNotNull())
    return windows_to_ends(F.size(tokens), ends, window, stride)


def first_decided(windows: DataFrame, key: str) -> DataFrame:
    """Of windows (key, lo, hi) the one that decides each token: the first that covers it."""
    t = windows.select(key, "lo", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("tok"))
    return t.groupBy(key, "tok").agg(F.min("lo").alias("decided_by"))


def sections_in_tokens(docs: DataFrame, key: str, text: str, sections: Column) -> DataFrame:
    """section_ranges of each row's text and its sections, in order, with their ord: only the ranges leave the row, never tokens."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t, secs in zip(*batch.columns):
                starts, secs = [m.start() for m in TOKEN.finditer(t.as_py() or "")], secs.as_py() or []
                cuts = [bisect_left(starts, s["start"]) for s in secs] + [len(starts)]
                rows += [(k, i, s["name"], cuts[i], cuts[i + 1]) for i, s in enumerate(secs) if cuts[i] < cuts[i + 1]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (batch.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32()))], ["k", "ord", "name", "lo", "hi"])

    out = StructType([StructField("k", kind), StructField("ord", IntegerType(), False), StructField("name", StringType()), StructField("lo", IntegerType()), StructField("hi", IntegerType())])
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t"), sections.alias("s")).mapInArrow(run, out).withColumnRenamed("k", key)


def section_ranges(tokens: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """key, name, lo, hi: tokens (key, tok, start) of each section (key, ord, name, start, end), a token belonging to the section
    its start lies in; sections without tokens have no row, tokens behind the last section belong to the last."""
    s = sections.select(key, "ord", "name", F.col("start").alias("a_"), F.coalesce(F.lead("start").over(Window.partitionBy(key).orderBy("ord")), F.lit(2**31 - 1)).alias("b_"))
    hit = tokens.select(key, "tok", "start").join(s, key).where((F.col("start") >= F.col("a_")) & (F.col("start") < F.col("b_")))
    return hit.groupBy(key, "ord", "name").agg(F.min("tok").alias("lo"), (F.max("tok") + 1).alias("hi"))


def truncated_at(pieces: Column, budget: int) -> Column:
    """The first token that a window of so many sub-words has no room for (pieces: sub-words of each token), null if all fit."""
    step = lambda acc, n: F.struct((acc["used"] + n).cast("bigint").alias("used"), F.when(acc["used"] + n <= budget, acc["fits"] + 1).otherwise(acc["fits"]).cast("int").alias("fits"))
    fits = F.aggregate(pieces, F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("fits")), step, lambda acc: acc["fits"])
    return F.when(fits < F.size(pieces), fits)


def subword_labels(tags: Column, pieces: Column, ignored: str = "-100") -> Column:
    """Labels of sub-words: the first of each token has its tag, the others are ignored."""
    rest = lambda n: F.array_repeat(F.lit(ignored), F.greatest(n - 1, F.lit(0)).cast("int"))
    return F.flatten(F.transform(F.arrays_zip(tags.alias("t"), pieces.alias("n")), lambda x: F.when(x["n"] > 0, F.concat(F.array(x["t"]), rest(x["n"]))).otherwise(F.array().cast("array<string>"))))
