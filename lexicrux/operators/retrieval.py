"""Passages, BM25, cosine, reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicrux.functions import text as T
from lexicrux.functions.spans import let
from lexicrux.staging import bounded, stage

K1, B = 1.5, 0.75
RRF = 60
#: Queries compared with all rows in one scan.
BLOCK = 16_384


def _tail(cur: Column, overlap: int) -> Column:
    """What the next passage takes over: the last `overlap` characters from the first sentence end, else blank, in them."""
    t = F.substring(cur, F.greatest(F.length(cur) - overlap, F.lit(0)) + 1, F.lit(overlap))
    rest = lambda rx: F.regexp_replace(t, rx, "")
    cut = F.when(t.rlike(r"[.!?;…]\s+"), rest(r"(?s)^.*?[.!?;…]\s+")).when(F.contains(t, F.lit(" ")), rest(r"(?s)^[^ ]* ")).otherwise(t)
    return F.when(F.length(cur) <= overlap, cur).otherwise(cut)


def passages(text: Column, target: int = 900, overlap: int = 150) -> Column:
    """Passages of whole sentences up to about `target` characters, each taking over the end of the one before; a sentence
    longer than that is cut in steps, without taking over."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    none = F.array().cast("array<string>")
    state = lambda cur, out: F.struct(cur.alias("cur"), out.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        cur, out = acc["cur"], acc["out"]
        flushed = F.when(cur != "", F.array_append(out, cur)).otherwise(out)
        pieces = F.transform(F.sequence(F.lit(0), F.length(s) - 1, F.lit(max(target - overlap, 1))), lambda i: F.substring(s, i + 1, F.lit(target)))
        full = (cur != "") & (F.length(cur) + 1 + F.length(s) > target)
        return (
            F.when(F.length(s) > target, state(F.lit(""), F.concat(flushed, pieces)))
            .when(full, state(trim(F.concat_ws(" ", _tail(cur, overlap), s)), F.array_append(out, cur)))
            .otherwise(state(F.when(cur == "", s).otherwise(F.concat_ws(" ", cur, s)), out))
        )

    end = lambda acc: F.when(acc["cur"] != "", F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"])
    return F.coalesce(F.aggregate(T.sentences(text), state(F.lit(""), none), step, end), none)


def chunked(docs: DataFrame, text: str, store: DataFrame | None) -> DataFrame:
    """hash, chunk, text, made (new or kept): passages of every different text, those of texts the store holds as it has them.

    store: hash, chunk, text of an earlier call; texts are told apart by their SHA-1, so that a text is cut once however
    often and in whatever document it comes again."""
    own = docs.where(F.col(text).isNotNull()).groupBy(F.sha1(text).alias("hash")).agg(F.first(text).alias("whole"))
    kept = None
    if store is not None:
        kept = store.select("hash", "chunk", "text").join(own.select("hash"), "hash", "left_semi").withColumn("made", F.lit("kept"))
        own = own.join(store.select("hash").distinct(), "hash", "left_anti")
    new = own.select("hash", F.posexplode(passages(F.col("whole"))).alias("chunk", "text")).withColumn("made", F.lit("new"))
    return new if kept is None else new.unionByName(kept)


def bm25(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, score of every document that holds a term. Counts of the query's terms only leave the scan, one row a document;
    document frequencies and the mean length are counted over all documents."""
    terms = sorted(set(terms))
    if not terms:
        return docs.select(key).limit(0).withColumn("score", F.lit(0.0))
    count = lambda ws: F.struct(F.size(ws).alias("len"), F.array(*(F.size(F.array_remove(ws, x)) for x in terms)).alias("rest"))
    # a generator keeps the counts in one place: a plain projection would be computed anew for every term that names it
    one = docs.select(key, F.explode(F.array(let(T.words(F.coalesce(text, F.lit(""))), count))).alias("c"))
    # texts are tokenised once; statistics and scores are both taken from the counts
    tf = stage(one.select(key, F.col("c.len").alias("len"), *((F.col("c.len") - F.col("c.rest")[i]).alias(f"tf{i}") for i in range(len(terms)))))
    s = tf.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf, f = float(np.log(1 + (s["n"] - s[f"df{i}"] + 0.5) / (s[f"df{i}"] + 0.5))), F.col(f"tf{i}")
        score = score + F.lit(idf) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("len") / F.lit(s["avg"] or 1.0)))
    return tf.select(key, score.alias("score")).where("score > 0")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_topk(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """q, key, sim: the k rows of base most similar to each query (key, vector), in exact blocks of queries against all rows.

    Queries are spread over blocks by hash, so that the driver holds one block at a time and base is scanned once a block.
    Rows of another length, or without length, have no similarity; ties go to the lesser key; a row isn't its own result."""
    spark = base.sparkSession
    asks = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("q"), F.col(vector).alias("v"))
    blocks = -(-asks.count() // BLOCK)
    out = None
    for no in range(blocks):
        by: dict[int, list] = {}
        for r in bounded(asks.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == no), 4 * BLOCK, "a block of queries"):
            by.setdefault(len(r.v), []).append((r.q, r.v))
        sent = spark.sparkContext.broadcast({n: (np.array([q for q, _ in rows]), np.array([v for _, v in rows], np.float64)) for n, rows in by.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own: dict[int, list] = {}
                for key_, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if v is not None and len(v) in sent.value:
                        own.setdefault(len(v), []).append((key_, v))
                for n, rows in own.items():
                    names, m = sent.value[n]
                    keys, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
                    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
                    own_units = unit(x).T
                    for lo in range(0, len(names), 1024):
                        sims = unit(m[lo : lo + 1024]) @ own_units
                        sims[names[lo : lo + 1024, None] == keys[None, :]] = -np.inf
                        kk = min(k, sims.shape[1])
                        kth = np.partition(sims, sims.shape[1] - kk, 1)[:, -kk]
                        i, j = np.nonzero((sims >= kth[:, None]) & np.isfinite(sims))
                        yield pa.RecordBatch.from_arrays([pa.array(names[lo + i], pa.int64()), pa.array(keys[j], pa.int64()), pa.array(sims[i, j])], ["q", "k", "sim"])

        part = base.select(F.col(key).cast("bigint"), vector).mapInArrow(run, "q BIGINT, k BIGINT, sim DOUBLE")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"q BIGINT, `{key}` BIGINT, sim DOUBLE")
    ranked = out.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "k")))
    return ranked.where(F.col("r") <= k).select("q", F.col("k").alias(key), "sim")


def fused(legs: list[DataFrame], key: str, k: int, score: str = "score") -> DataFrame:
    """The k best of scored lists by reciprocal rank fusion, ties by key: key, rrf.

    The k-th of any one list scores 1 / (RRF + k) at least. Who is beyond place m = n (RRF + k) - RRF of all n lists scores
    less, so at most m rows a list can win. Their exact ranks are counted over all rows, by how many candidates are better
    than each row; no list is ever sorted in one task. Each list is staged once."""
    spark, m = legs[0].sparkSession, len(legs) * (RRF + k) - RRF
    legs = [stage(leg.select(key, score)) for leg in legs]
    order = [F.desc(score), F.col(key)]
    wanted = sorted({r[0] for leg in legs for r in leg.select(key, score).orderBy(*order).limit(m).collect()})
    total: dict = dict.fromkeys(wanted, 0.0)
    for leg in legs:
        own = sorted((-r[1], r[0]) for r in leg.where(F.col(key).isin(wanted)).select(key, score).collect())
        if not own:
            continue
        cands = F.array(*(F.struct(F.lit(a).alias("s"), F.lit(b).alias("k")) for a, b in own))
        row = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))
        place = F.size(F.filter(cands, lambda c: c < row))
        n = {r[0]: r[1] for r in leg.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}
        rank = 0
        for at, (_, name) in enumerate(own):
            rank += n.get(at, 0)
            total[name] += 1.0 / (RRF + rank)
    best = sorted(total.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return spark.createDataFrame(best, f"`{key}` {dict(legs[0].dtypes)[key]}, rrf DOUBLE")


def adaptive_k(chunks: Column) -> Column:
    return F.when(chunks == 0, 5).otherwise(F.greatest(F.lit(4), F.least(F.lit(8), F.floor(chunks / 6) + 4))).cast("int")


def upserted(old: DataFrame, new: DataFrame, key: str, order: list[str], kept: list[str]) -> DataFrame:
    """One row per key: the newest payload, but the columns `kept` as they came first."""
    both = old.unionByName(new)
    w = Window.partitionBy(key)
    last, first = w.orderBy(*(F.desc(c) for c in order)), w.orderBy(*order)
    ranked = both.withColumn("rn_", F.row_number().over(last))
    for c in kept:
        ranked = ranked.withColumn(c, F.first(c).over(first))
    return ranked.where("rn_ = 1").drop("rn_")


def related(articles: Column, crimes: Column, q_articles: list[str], q_words: list[str]) -> Column:
    a = F.arrays_overlap(articles, F.array(*map(F.lit, q_articles)).cast("array<string>"))
    c = F.arrays_overlap(T.crime_words(crimes), F.array(*map(F.lit, q_words)).cast("array<string>"))
    return F.coalesce(a, F.lit(False)) | F.coalesce(c, F.lit(False))


def match(cases: DataFrame, query: dict, k: int = 5, least: float = 0.0) -> DataFrame:
    """The k cases most like a query {vector, articles, crime_words}; only related ones, unless they are fewer than k."""
    q = F.array(*map(F.lit, query["vector"]))
    scored = cases.where(F.size("vector") == len(query["vector"])).withColumn("sim", dot(F.col("vector"), q)).withColumn("related", related(F.col("articles"), F.col("crimes"), query["articles"], query["crime_words"]))
    order = [F.desc("sim"), F.col("rec_no")]
    near = scored.where("related").orderBy(*order).limit(k).withColumn("pool", F.lit(1))
    both = near.unionByName(scored.orderBy(*order).limit(k).withColumn("pool", F.lit(2)))
    # at most 2 k rows
    chosen = both.withColumn("n_", F.count_if(F.col("pool") == 1).over(Window.partitionBy(F.lit(0)))).where((F.col("pool") == 1) == (F.col("n_") >= k))
    return chosen.drop("pool", "n_").orderBy(*order).limit(k).where(F.col("sim") >= least)
