"""Queries of passages, ranking and precedents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexicrux.functions import text as T
from lexicrux.operators import retrieval as R

QUERY = "bồi thường thiệt hại do tranh chấp lối đi chung tại thị trấn"
TERMS = sorted(set(QUERY.split()))


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunk_judgments(spark, d):
    own = _t(spark, d, "precedents").select("rec_no", F.posexplode(R.passages(F.col("full_text"))).alias("chunk", "text"))
    return own.select("rec_no", "chunk", "text")


def bm25_topk(spark, d):
    s = R.bm25(_t(spark, d, "documents"), "doc_id", "text", TERMS)
    return s.orderBy(F.desc(F.round("score", 6)), "doc_id").limit(50).select("doc_id", F.round("score", 6).alias("score"))


def passage_bm25(spark, d):
    """The best passages of all judgments for the query."""
    c = chunk_judgments(spark, d).withColumn("id", F.format_string("%d#%d", "rec_no", "chunk"))
    s = R.bm25(c, "id", "text", TERMS)
    return s.orderBy(F.desc(F.round("score", 6)), "id").limit(20).select("id", F.round("score", 6).alias("score"))


def cosine_topk(spark, d):
    e = _t(spark, d, "embeddings")
    out = R.cosine_topk(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    return out.select(F.col("q").alias("query_id"), "vec_id", F.round("sim", 5).alias("sim"))


def adaptive_k(spark, d):
    n = F.size(T.sentences(F.coalesce("text", F.lit(""))))
    return _t(spark, d, "documents").select("doc_id", R.adaptive_k(n).alias("k"))


def _query_case(spark, d):
    p = _t(spark, d, "precedents")
    r = p.where("size(vector) = dim AND dim = 64 AND forall(vector, x -> NOT isnan(x) AND abs(x) < 1e30)").orderBy("rec_no").select("rec_no", "vector", "articles", F.sort_array(T.crime_words(F.col("crimes"))).alias("w"), F.array_sort(F.array_distinct(T.words(F.col("title")))).alias("t")).first()
    if r is None:  # no case that could ask
        return p, {"rec_no": None, "vector": [0.0] * 64, "articles": [], "crime_words": [], "title": []}
    return p, {"rec_no": r.rec_no, "vector": r.vector, "articles": [x for x in r.articles or [] if x is not None], "crime_words": r.w or [], "title": r.t}


def _clean(p):
    return p.where("forall(vector, x -> NOT isnan(x) AND abs(x) < 1e30)")


def rrf_hybrid(spark, d):
    """Hybrid search of a case among the precedents: cosine of vectors and BM25 over facts, fused, in the table's order."""
    p, q = _query_case(spark, d)
    dense = _clean(p).where("size(vector) = 64").select("rec_no", F.round(R.dot(F.col("vector"), F.array(*map(F.lit, q["vector"]))), 6).alias("score"))
    sparse = R.bm25(p, "rec_no", "facts_summary", q["title"]).select("rec_no", F.round("score", 6).alias("score"))
    top = R.fused([dense, sparse], "rec_no", 10)
    return top.join(dense, "rec_no", "left").select("rec_no", F.col("score").alias("cosine"), F.round("rrf", 9).alias("rrf")).orderBy("rec_no")


def precedent_match_widen(spark, d):
    p, q = _query_case(spark, d)
    return R.match(_clean(p), q, 5).select("rec_no", F.round("sim", 5).alias("sim"), "related")


def precedent_search_boost(spark, d):
    p, q = _query_case(spark, d)
    hay = T.words(F.concat_ws(" ", "title", F.array_join("crimes", " "), F.array_join("articles", " "), "facts_summary"))
    hits = F.size(F.array_intersect(hay, F.array(*map(F.lit, q["title"])))) / float(len(q["title"]) or 1)
    own = _clean(p).where("size(vector) = 64").select("rec_no", R.dot(F.col("vector"), F.array(*map(F.lit, q["vector"]))).alias("sim"), hits.alias("kw"))
    return own.withColumn("score", F.round(F.col("sim") + 0.15 * F.col("kw"), 5)).orderBy(F.desc("score"), "rec_no").limit(8).select("rec_no", "score", F.round("sim", 5).alias("sim"))


def precedent_upsert(spark, d):
    p = _t(spark, d, "precedents").where("id IS NOT NULL").select("id", "rec_no", "created_at", "case_number", "title", "court")
    out = R.upserted(p.where("rec_no % 2 = 0"), p.where("rec_no % 2 = 1"), "id", ["rec_no"], ["created_at", "case_number"])
    return out.select("id", "rec_no", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "case_number", "title", "court")


def precedent_counts(spark, d):
    return _t(spark, d, "precedents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("id").alias("cases"))


QUERIES = {f.__name__: f for f in (chunk_judgments, bm25_topk, passage_bm25, cosine_topk, adaptive_k, rrf_hybrid, precedent_match_widen, precedent_search_boost, precedent_upsert, precedent_counts)}
_TERMS = "[" + ", ".join(f"'{x}'" for x in TERMS) + "]"
_BM25 = lambda table, key, text, terms: (
    rf"w AS (SELECT {key} AS k, regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]+') AS ws FROM {table}), g AS (SELECT count(*) AS n, avg(len(ws)) AS avg FROM w), q AS (SELECT DISTINCT unnest({terms}) AS term), "
    "tf AS (SELECT k, len(ws) AS dl, term, len(list_filter(ws, lambda x: x = term)) AS f FROM w, q), df AS (SELECT term, count(*) AS df FROM tf WHERE f > 0 GROUP BY term), "
    "sc AS (SELECT k, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (f * 2.5) / (f + 1.5 * (1 - 0.75 + 0.75 * dl / avg))) AS score FROM tf JOIN df USING (term), g WHERE f > 0 GROUP BY k)"
)
_CASE = r"""
fin AS (SELECT *, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM precedents WHERE vector IS NOT NULL AND len(list_filter(vector, lambda x: isnan(x) OR abs(x) >= 1e30)) = 0),
qc AS (SELECT rec_no AS qr, v AS qv, articles AS qa, list_filter(list_distinct(flatten(list_transform(list_filter(crimes, lambda x: x IS NOT NULL), lambda x: regexp_extract_all(lower(x), '[\p{L}\p{N}_]+')))), lambda x: x NOT IN ('tội', 'về', 'và', 'các', 'quy', 'định')) AS qw, list_distinct(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) AS qt FROM fin WHERE len(vector) = dim AND dim = 64 AND rec_no <= 20 ORDER BY rec_no LIMIT 1),
de AS (SELECT rec_no, list_inner_product(v, qv) AS sim, crimes, articles, title, facts_summary, qa, qw, qt FROM fin, qc WHERE len(v) = 64)"""
SQL = {
    "bm25_topk": f"WITH {_BM25('documents', 'doc_id', 'text', _TERMS)} SELECT k AS doc_id, round(score, 6) AS score FROM sc ORDER BY 2 DESC, 1 LIMIT 50",
    "cosine_topk": "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS r FROM s) SELECT query_id, vec_id, round(sim, 5) AS sim FROM r WHERE r <= 5",
    "adaptive_k": r"""WITH a AS (SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?;…])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS n FROM documents) SELECT doc_id, CAST(CASE WHEN n = 0 THEN 5 ELSE greatest(4, least(8, n // 6 + 4)) END AS INTEGER) AS k FROM a""",
    "rrf_hybrid": f"""
WITH {_CASE}, d1 AS (SELECT rec_no, round(sim, 6) AS c FROM de), {_BM25('precedents', 'rec_no', 'facts_summary', '(SELECT qt FROM qc)')},
r AS (SELECT rec_no, row_number() OVER (ORDER BY c DESC, rec_no) AS rank FROM d1 UNION ALL SELECT k, row_number() OVER (ORDER BY round(score, 6) DESC, k) FROM sc),
f AS (SELECT rec_no, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM r GROUP BY rec_no ORDER BY 2 DESC, 1 LIMIT 10)
SELECT f.rec_no, c AS cosine, rrf FROM f LEFT JOIN d1 USING (rec_no)""",
    "precedent_match_widen": rf"""
WITH {_CASE}, s AS (SELECT rec_no, sim, coalesce(list_has_any(articles, list_filter(qa, lambda x: x IS NOT NULL)), false) OR coalesce(list_has_any(list_filter(flatten(list_transform(list_filter(crimes, lambda x: x IS NOT NULL), lambda x: regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}_]+'))), lambda x: x NOT IN ('tội', 'về', 'và', 'các', 'quy', 'định')), qw), false) AS related FROM de),
c AS (SELECT count(*) FILTER (related) >= 5 AS enough FROM s)
SELECT rec_no, round(sim, 5) AS sim, related FROM (SELECT s.* FROM s, c WHERE related OR NOT enough ORDER BY sim DESC, rec_no LIMIT 5) WHERE sim >= 0""",
    "precedent_search_boost": rf"""
WITH {_CASE}, s AS (SELECT rec_no, sim, len(list_filter(qt, lambda x: list_contains(regexp_extract_all(lower(concat_ws(' ', title, array_to_string(list_filter(crimes, lambda x: x IS NOT NULL), ' '), array_to_string(list_filter(articles, lambda x: x IS NOT NULL), ' '), facts_summary)), '[\p{{L}}\p{{N}}_]+'), x))) / len(qt) AS kw FROM de)
SELECT rec_no, round(sim + 0.15 * kw, 5) AS score, round(sim, 5) AS sim FROM s ORDER BY 2 DESC, 1 LIMIT 8""",
    "precedent_upsert": """
WITH r AS (SELECT id, rec_no, strftime(first_value(created_at) OVER w, '%Y-%m-%d %H:%M:%S') AS created_at, first_value(case_number) OVER w AS case_number, title, court, row_number() OVER (PARTITION BY id ORDER BY rec_no DESC) AS rn
FROM precedents WHERE id IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY rec_no)) SELECT id, rec_no, created_at, case_number, title, court FROM r WHERE rn = 1""",
    "precedent_counts": "SELECT source, count(*) AS n, count(DISTINCT id) AS cases FROM precedents GROUP BY source",
}
