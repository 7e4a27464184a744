"""Queries over spans, sections, tokens and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexicrux.functions import spans as S
from lexicrux.operators import windows as W


def _texts(spark, d):
    return spark.read.parquet(f"{d}/gold_texts.parquet").where("text IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"))


def _judgments(spark, d):
    return spark.read.parquet(f"{d}/precedents.parquet").select("rec_no", "full_text")


def _exploded(df, key, spans):
    return df.select(key, F.posexplode(spans).alias("ord", "s")).select(key, "ord", "s.*")


def span_article_clause(spark, d):
    t = F.col("full_text")
    every = F.concat(*(S.matches(t, rx, label) for label, rx, _ in S.PATTERNS if label in ("ARTICLE", "CLAUSE", "CASE_NUMBER")))
    return _judgments(spark, d).select("rec_no", F.explode(every).alias("s")).groupBy("rec_no", "s.label", "s.text").agg(F.count("*").alias("n"), F.min("s.start").alias("first_at"))


#: Patterns without look-around, which other engines read alike.
PLAIN = [p for p in S.PATTERNS if not any(x in p[1] for x in ("(?!", "(?=", "(?<")) and p[0] not in ("ARTICLE", "CLAUSE")]


def label_patterns(spark, d):
    """Spans of the labels whose patterns need no look-around, names that are none left out."""
    t = F.col("full_text")
    parts = []
    for label, rx, group in PLAIN:
        found = S.matches(t, rx, label, group)
        parts.append(F.filter(found, lambda s: ~F.split(s["text"], r"\s+")[0].isin(*S.NOT_NAMES)) if label in ("DEFENDANT", "PLAINTIFF", "VICTIM", "RELATED_PARTY") else found)
    return _judgments(spark, d).select("rec_no", F.explode(F.concat(*parts)).alias("s")).groupBy("rec_no", "s.label", "s.text").agg(F.count("*").alias("n"), F.min("s.start").alias("first_at"))


def judgment_dates(spark, d):
    """Dates of a judgment by what stands around them."""
    return _exploded(_judgments(spark, d), "rec_no", S.dates(F.col("full_text"))).groupBy("rec_no", "text").agg(F.count("*").alias("n"), F.min("start").alias("first_at"))


def factor_phrases(spark, d):
    """Mitigating and aggravating phrases in sentences made of them, in capitals, with line ends and without accents."""
    k = F.col("rec_no").cast("int")
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), by % len(words) + 1)
    m, a = pick(S.MITIGATING, k), pick(S.AGGRAVATING, k)
    text = F.concat(F.lit("Bị cáo đã "), F.when(k % 2 == 0, F.upper(m)).otherwise(F.replace(m, F.lit(" "), F.lit("\n"))), F.lit(", nhưng thuộc trường hợp "), a, F.lit("."))
    p = spark.read.parquet(f"{d}/precedents.parquet").select("rec_no", S.factors(text).alias("f"))
    return _exploded(p, "rec_no", F.col("f")).select("rec_no", "ord", "label", "start", "end", "text")


def span_money_context(spark, d):
    return _judgments(spark, d).select("rec_no", F.explode(S.money(F.col("full_text"))).alias("s")).groupBy("rec_no", "s.label").agg(F.count("*").alias("n"), F.min("s.start").alias("first_at"))


def entity_spans(spark, d):
    return _exploded(_texts(spark, d), "doc_id", S.entities(F.col("text")))


def label_counts(spark, d):
    return entity_spans(spark, d).groupBy("label").agg(F.count("*").alias("spans"), F.count_distinct("doc_id").alias("docs"))


def factor_spans(spark, d):
    return _exploded(_judgments(spark, d), "rec_no", S.factors(F.col("full_text")))


def sectioning(spark, d):
    return _exploded(_judgments(spark, d).where("full_text IS NOT NULL"), "rec_no", S.sections(F.col("full_text")))


def _gold(spark, d):
    own = spark.read.parquet(f"{d}/gold_spans.parquet").select(F.col("id").alias("doc_id"), F.posexplode("spans").alias("ord", "s"))
    return own.select("doc_id", "ord", "s.label", "s.start", "s.end")


def tokenize(spark, d):
    t = W.tokenized(_texts(spark, d), "doc_id", "text")
    return t.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.max("end").alias("last_end"), F.sum(F.length("token")).alias("chars"))


def bio_encode(spark, d):
    return W.bio_encode(W.tokenized(_texts(spark, d), "doc_id", "text"), _gold(spark, d), "doc_id").where("tag <> 'O'").select("doc_id", "tok", "token", "tag")


def bio_decode(spark, d):
    return W.bio_decode(W.bio_encode(W.tokenized(_texts(spark, d), "doc_id", "text"), _gold(spark, d), "doc_id"), "doc_id")


def training_chunks(spark, d):
    tagged = W.bio_encode(W.tokenized(_texts(spark, d), "doc_id", "text"), _gold(spark, d), "doc_id")
    rows = tagged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tok", "token", "tag"))).alias("t")).withColumn("tags", F.transform("t", lambda x: x["tag"]))
    parts = rows.select("doc_id", "t", F.posexplode(W.chunk_ranges(F.col("tags"), 120)).alias("k", "r"))
    piece = F.slice("t", F.col("r.lo") + 1, F.col("r.hi") - F.col("r.lo"))
    return parts.select(F.concat_ws("#", "doc_id", "k").alias("id"), F.transform(piece, lambda x: x["token"]).alias("tokens"), F.transform(piece, lambda x: x["tag"]).alias("tags"))


def sliding_windows(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return docs.select("doc_id", n.alias("n")).select("doc_id", "n", F.explode(W.sliding(F.col("n"))).alias("lo")).select("doc_id", "lo", F.least("n", F.col("lo") + W.WINDOW).alias("hi"))


def sentence_windows(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL")
    ends = W.sentence_ends(docs, "doc_id", "text")
    return ends.select("doc_id", F.posexplode(W.windows_to_ends(F.col("n"), F.col("ends"))).alias("ord", "r")).select("doc_id", "ord", "r.lo", "r.hi")


def first_decided_merge(spark, d):
    return W.first_decided(sliding_windows(spark, d), "doc_id").groupBy("doc_id", "decided_by").agg(F.count("*").alias("tokens"))


def _intervals(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    a = (F.col("l_partkey") % 200).cast("int")
    label = F.element_at(F.array(*map(F.lit, ("PENALTY", "CRIME", "LAW_NAME", "ARTICLE"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return li.select("l_orderkey", a.alias("start"), (a + 5 + F.col("l_suppkey") % 30).cast("int").alias("end"), label.alias("label"))


def overlap_resolve(spark, d):
    s = F.struct("start", "end", "label", F.lit("").alias("text"))
    kept = _intervals(spark, d).groupBy("l_orderkey").agg(F.collect_list(s).alias("spans")).select("l_orderkey", S.resolved(F.col("spans")).alias("kept"))
    return kept.select("l_orderkey", F.size("kept").alias("kept_spans"), F.aggregate("kept", F.lit(0), lambda a, x: a + x["end"] - x["start"]).alias("covered"))


def interval_gaps(spark, d):
    s = F.array_sort(F.collect_list(F.struct("start", "end")))
    own = _intervals(spark, d).groupBy("l_orderkey").agg(s.alias("spans"))
    return own.select("l_orderkey", F.explode(S.gaps(F.col("spans"), F.lit(0), F.lit(240))).alias("g")).select("l_orderkey", "g.start", "g.end")


QUERIES = {f.__name__: f for f in (span_article_clause, label_patterns, judgment_dates, factor_phrases, span_money_context, entity_spans, label_counts, factor_spans, sectioning, tokenize, bio_encode, bio_decode, training_chunks, sliding_windows, sentence_windows, first_decided_merge, overlap_resolve, interval_gaps)}
_DOCS = "t AS (SELECT doc_id, min(text) AS text FROM gold_texts WHERE text IS NOT NULL GROUP BY doc_id)"
_SCAN = lambda table, key, text, rx: (
    f"SELECT {key}, unnest(regexp_extract_all({text}, '{rx}')) AS m, unnest(list_slice(string_split_regex({text}, '{rx}'), 1, len(regexp_extract_all({text}, '{rx}')))) AS g, generate_subscripts(regexp_extract_all({text}, '{rx}'), 1) AS i FROM {table}"
)
_TOK = (
    "tk AS ("
    + _SCAN("t", "doc_id", "text", r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")
    + "), tok AS (SELECT doc_id, i - 1 AS tok, m AS token, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM tk), tokens AS (SELECT doc_id, tok, token, e - length(token) AS s, e FROM tok)"
)
_TAG = (
    "sp AS (SELECT id AS doc_id, unnest(spans) AS s, generate_subscripts(spans, 1) - 1 AS ord FROM gold_spans), "
    "hit AS (SELECT tokens.doc_id, tok, token, tokens.s, tokens.e, ord, sp.s.label AS label, row_number() OVER (PARTITION BY tokens.doc_id, ord ORDER BY tok) AS r FROM tokens JOIN sp ON tokens.doc_id = sp.doc_id AND tokens.s < sp.s.\"end\" AND tokens.e > sp.s.\"start\"), "
    "tag AS (SELECT doc_id, tok, any_value(token) AS token, any_value(s) AS s, any_value(e) AS e, max_by(CASE WHEN r = 1 THEN 'B-' ELSE 'I-' END || label, ord) AS tag FROM hit GROUP BY doc_id, tok)"
)
_INNER = lambda label, rx, group: (
    f"SELECT '{label}' AS label, rec_no, unnest(regexp_extract_all(full_text, '{rx}')) AS m, unnest(regexp_extract_all(full_text, '{rx}', {group})) AS p, unnest(list_slice(string_split_regex(full_text, '{rx}'), 1, len(regexp_extract_all(full_text, '{rx}')))) AS g, generate_subscripts(regexp_extract_all(full_text, '{rx}'), 1) AS i FROM precedents"
)
_DATES = lambda rx, kind: f"SELECT '{kind}' AS kind, * FROM ({_SCAN('precedents', 'rec_no', 'full_text', rx)})"
SQL = {
    "label_patterns": "WITH "
    + ", ".join(f"a{n} AS ({_INNER(*p)}), b{n} AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY rec_no ORDER BY i) - CASE WHEN ends_with(m, p) THEN 0 ELSE 1 END AS e FROM a{n})" for n, p in enumerate(PLAIN))
    + ", u AS ("
    + " UNION ALL ".join(f"SELECT rec_no, label, p, e - length(p) AS s FROM b{n}" + (" WHERE regexp_extract(p, '^\\S+', 0) NOT IN (" + ", ".join(f"'{w}'" for w in S.NOT_NAMES) + ")" if p[0] in ("DEFENDANT", "PLAINTIFF", "VICTIM", "RELATED_PARTY") else "") for n, p in enumerate(PLAIN))
    + ") SELECT rec_no, label, p AS text, count(*) AS n, CAST(min(s) AS INTEGER) AS first_at FROM u GROUP BY ALL",
    "judgment_dates": f"WITH a AS ({_DATES(S.DATE_NUMERIC, 'n')} UNION ALL {_DATES(S.DATE_VERBOSE, 'v')}), b AS (SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY rec_no, kind ORDER BY i) AS INTEGER) AS e FROM a), "
    + "c AS (SELECT b.*, e - length(m) AS s, full_text AS t FROM b JOIN precedents USING (rec_no)), d AS (SELECT *, " + ", ".join(f"substr(t, greatest(s - {n}, 0) + 1, least(s, {n})) AS w{n}" for n in (30, 40, 120, 160)) + ", substr(t, e + 1, 160) AS after FROM c) "
    + rf"SELECT rec_no, m AS text, count(*) AS n, CAST(min(s) AS INTEGER) AS first_at FROM d WHERE CASE WHEN kind = 'n' THEN regexp_matches(w120, '{S.HEADER}') ELSE NOT regexp_matches(w30, '\d+/\d{{4}}/[\p{{L}}\p{{M}}\p{{N}}_-]+\s*$') AND (regexp_matches(after, 'xét\s+xử|tuyên\s+án') OR regexp_matches(w160, '{S.HEADER}') OR regexp_matches(w40, '[Tt]uyên\s+án\s*:?\s*$')) END GROUP BY ALL",
    "factor_phrases": f"WITH m AS (SELECT {list(S.MITIGATING)} AS ms, {list(S.AGGRAVATING)} AS gs), a AS (SELECT rec_no, ms[CAST(rec_no % {len(S.MITIGATING)} AS INTEGER) + 1] AS m, gs[CAST(rec_no % {len(S.AGGRAVATING)} AS INTEGER) + 1] AS g FROM precedents, m), "
    "b AS (SELECT rec_no, CASE WHEN rec_no % 2 = 0 THEN upper(m) ELSE replace(m, ' ', chr(10)) END AS x, g FROM a), c AS (SELECT rec_no, 'MITIGATING_FACTOR' AS label, 10 AS s, x FROM b UNION ALL SELECT rec_no, 'AGGRAVATING_FACTOR', 10 + length(x) + length(', nhưng thuộc trường hợp '), g FROM b) "
    "SELECT rec_no, CAST(row_number() OVER (PARTITION BY rec_no ORDER BY s) - 1 AS INTEGER) AS ord, label, CAST(s AS INTEGER) AS start, CAST(s + length(x) AS INTEGER) AS \"end\", x AS text FROM c",
    "span_article_clause": "WITH a AS ("
    + " UNION ALL ".join(f"SELECT '{label}' AS label, * FROM ({_SCAN('precedents', 'rec_no', 'full_text', rx)})" for label, rx in (("ARTICLE", r"[Đđ]iều\s+\d+[a-zđ]?\b"), ("CLAUSE", r"[Kk]hoản\s+\d+\b"), ("CASE_NUMBER", r"\b\d{1,4}\s*/\s*\d{4}/[A-ZĐ][A-ZĐ0-9]*(?:\s*-\s*[A-ZĐ][A-ZĐ0-9]*)*")))
    + "), b AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY rec_no, label ORDER BY i) - length(m) AS pos FROM a) SELECT rec_no, label, m AS text, count(*) AS n, CAST(min(pos) AS INTEGER) AS first_at FROM b GROUP BY ALL",
    "tokenize": f"WITH {_DOCS}, {_TOK} SELECT doc_id, count(*) AS tokens, CAST(max(e) AS INTEGER) AS last_end, CAST(sum(length(token)) AS BIGINT) AS chars FROM tokens GROUP BY doc_id",
    "bio_encode": f"WITH {_DOCS}, {_TOK}, {_TAG} SELECT doc_id, CAST(tok AS INTEGER) AS tok, token, tag FROM tag",
    "bio_decode": f"WITH {_DOCS}, {_TOK}, {_TAG}, x AS (SELECT *, tag[3:] AS label, CASE WHEN tag[1:1] = 'I' AND lag(tag[3:]) OVER w = tag[3:] AND lag(tok) OVER w = tok - 1 THEN 0 ELSE 1 END AS o FROM tag WINDOW w AS (PARTITION BY doc_id ORDER BY tok)), "
    "y AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY tok) AS run FROM x) SELECT doc_id, any_value(label) AS label, CAST(min(s) AS INTEGER) AS start, CAST(max(e) AS INTEGER) AS \"end\", CAST(run - 1 AS INTEGER) AS ord FROM y GROUP BY doc_id, run",
    "sliding_windows": r"WITH a AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) AS n FROM documents), b AS (SELECT doc_id, n, unnest(generate_series(0, greatest(0, CAST(ceil((n - 200) / 150.0) AS INTEGER)))) * 150 AS lo FROM a WHERE n > 0) SELECT doc_id, CAST(lo AS INTEGER) AS lo, CAST(least(n, lo + 200) AS INTEGER) AS hi FROM b",
    "first_decided_merge": r"WITH a AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) AS n FROM documents), b AS (SELECT doc_id, n, unnest(generate_series(0, greatest(0, CAST(ceil((n - 200) / 150.0) AS INTEGER)))) * 150 AS lo FROM a WHERE n > 0) SELECT doc_id, CAST(lo AS INTEGER) AS decided_by, CAST(least(n, lo + 200) - CASE WHEN lo = 0 THEN 0 ELSE lo + 50 END AS BIGINT) AS tokens FROM b WHERE least(n, lo + 200) > CASE WHEN lo = 0 THEN 0 ELSE lo + 50 END",
    "interval_gaps": """
WITH i AS (SELECT l_orderkey, CAST(l_partkey % 200 AS INTEGER) AS s, CAST(l_partkey % 200 + 5 + l_suppkey % 30 AS INTEGER) AS e FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 240, 240 FROM lineitem),
m AS (SELECT *, coalesce(max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM i)
SELECT l_orderkey, done AS start, s AS "end" FROM m WHERE s > done""",
}
