"""Queries over text scalars: normalisation, keys, dates, case metadata, article references."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexicrux.functions import text as T


def _p(spark, d, *cols):
    return spark.read.parquet(f"{d}/precedents.parquet").select(*cols)


def normalize_text(spark, d):
    return _p(spark, d, "rec_no", T.normal(F.col("full_text")).alias("normalized"))


def flatten_documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.flat(F.col("text")).alias("flat"))


def fold_titles(spark, d):
    return _p(spark, d, "rec_no", T.folded(F.col("title")).alias("folded"), F.lower(T.folded(F.col("title"), keep_d=True)).alias("folded_keep_d"))


def case_number_normalize(spark, d):
    key = T.case_key(F.col("case_number"))
    return _p(spark, d, "rec_no", key.alias("case_key"), T.core_number(key).alias("core"), T.court_key(F.col("court")).alias("court_key"))


def doc_meta(spark, d):
    c = F.col("case_number")
    return _p(spark, d, "rec_no", T.case_type(c).alias("kind"), T.case_stage(c).alias("stage"))


def dates_normalize(spark, d):
    raw = F.regexp_extract("full_text", r"(\d{1,2}[/.-]\d{1,2}[/.-]\d{4})", 1)
    return _p(spark, d, "rec_no", T.iso_date(raw).alias("iso"), T.iso_date(F.date_format("created_at", "yyyy-MM-dd")).alias("created"), T.written_date(raw).alias("written"))


def article_references(spark, d):
    return _p(spark, d, "rec_no", F.array_join(T.article_refs(F.col("full_text")), "|").alias("refs"))


def crime_token_sets(spark, d):
    return _p(spark, d, "rec_no", F.array_join(F.array_sort(T.crime_words(F.col("crimes"))), " ").alias("tokens"))


def matching_keys(spark, d):
    clean = lambda c: F.filter(c, lambda x: x.isNotNull())
    return _p(spark, d, "rec_no", T.matching_key(clean(F.col("crimes")), clean(F.col("articles")), F.col("facts_summary")).alias("key"))


FACTS, REASON = r"NỘI\s*DUNG\s*VỤ\s*ÁN", r"NHẬN\s*ĐỊNH"


def facts_summary(spark, d):
    return _p(spark, d, "rec_no", F.coalesce(T.between(F.col("full_text"), FACTS, REASON, 1200, 300), F.lit("")).alias("facts"))


def law_name_keys(spark, d):
    c = spark.read.parquet(f"{d}/parsed_citations.parquet").where("law_text IS NOT NULL").select("law_text").distinct()
    return c.select("law_text", T.law_key(F.col("law_text")).alias("law_key"), T.law_in_title(F.col("law_text"), F.lit("Văn bản hợp nhất Bộ luật Tố tụng hình sự")).alias("in_procedure_title"))


def content_hash_dedup(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha1(F.coalesce("text", F.lit(""))).alias("hash"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def token_counts(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.size(T.words(F.coalesce("text", F.lit("")))).alias("words"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(T.WORD + r"|[^\p{L}\p{N}_\s]"), F.lit(0))).alias("tokens"))


def sentence_split(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("ord", "sentence"))


def money_numbers(spark, d):
    raw = F.explode(F.array_distinct(F.regexp_extract_all("facts_summary", F.lit(r"(\d{1,3}(?:[.]\d{3})+)(?: đồng|đ)"), F.lit(1))))
    return _p(spark, d, "rec_no", raw.alias("raw")).select("rec_no", "raw", T.number_of(F.col("raw"), F.lit(True)).alias("value"))


# fixed values: what titles of criminal and of civil cases contain
CRIMINAL = ("hình sự", "hs-st", "hs-pt", "hsst", "hspt")
CIVIL = (
    "ds-st", "ds-pt", "dsst", "dspt", "qđds", "qдds", "hngđ", "hngd", "hn-st", "hn-pt", "hnst", "hnpt", "kdtm", "kdtm-st", "kdtm-pt",
    "lđ-st", "lđ-pt", "lđst", "lđpt", "ld-st", "ld-pt", "hc-st", "hc-pt", "hcst", "hcpt", "qđhc", "dân sự", "hôn nhân", "gia đình",
    "hành chính", "kinh doanh", "thương mại", "lao động", "ly hôn", "tranh chấp", "khiếu kiện", "yêu cầu", "chia tài sản", "thừa kế", "đòi nợ", "hợp đồng",
)


def crawl_classify(spark, d):
    low = F.lower(F.coalesce("title", F.lit("")))
    any_of = lambda ms: F.exists(F.array(*map(F.lit, ms)), lambda m: F.contains(low, m))
    return _p(spark, d, "rec_no", any_of(CRIMINAL).alias("criminal"), (~any_of(CRIMINAL) & any_of(CIVIL)).alias("civil"))


_FOLD = "strip_accents(replace(replace({0}, 'đ', 'd'), 'Đ', 'D'))"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
QUERIES = {f.__name__: f for f in (normalize_text, flatten_documents, fold_titles, case_number_normalize, doc_meta, dates_normalize, article_references, crime_token_sets, matching_keys, facts_summary, law_name_keys, content_hash_dedup, token_counts, sentence_split, money_numbers, crawl_classify)}
_CASE = "CASE " + " ".join(f"WHEN contains(s, '{c}') THEN '{n}'" for c, n in T.CASE_TYPES) + " END"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SQL = {
    "normalize_text": r"""
WITH a AS (SELECT rec_no, translate(full_text, 'ƣƢ', 'ưƯ') AS t FROM precedents),
b AS (SELECT rec_no, regexp_replace(regexp_replace(t, '([\p{L}\p{N}_])[ ' || chr(160) || ']+([' || chr(803) || chr(768) || chr(769) || chr(771) || chr(777) || '])', '\1\2', 'g'), '([\p{L}\p{N}_])[ ' || chr(160) || ']+([' || chr(803) || chr(768) || chr(769) || chr(771) || chr(777) || '])', '\1\2', 'g') AS t FROM a),
c AS (SELECT rec_no, regexp_replace(nfc_normalize(t), '[ \t' || chr(160) || ']+', ' ', 'g') AS t FROM b),
e AS (SELECT rec_no, array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)) AS t FROM c)
SELECT rec_no, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS normalized FROM e""",
    "flatten_documents": r"""
WITH a AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '' AND NOT regexp_full_match(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\p{Nd}+')), ' ') AS t FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(t, '[ \t' || chr(160) || ']+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS flat FROM a""",
    "fold_titles": f"SELECT rec_no, {_FOLD.format('title')} AS folded, replace(lower(replace(strip_accents(replace(replace(title, 'đ', chr(1)), 'Đ', chr(2))), chr(2), chr(1))), chr(1), 'đ') AS folded_keep_d FROM precedents",
    "case_number_normalize": f"""
WITH a AS (SELECT rec_no, coalesce(regexp_replace(upper({_FOLD.format('case_number')}), '[^A-Z0-9]', '', 'g'), '') AS case_key,
  coalesce(trim(regexp_replace(regexp_replace(upper({_FOLD.format('court')}), '[^A-Z0-9]', ' ', 'g'), ' +', ' ', 'g')), '') AS court_key FROM precedents)
SELECT rec_no, case_key, CASE WHEN regexp_extract(case_key, '^(\\d+)', 1) = '' THEN case_key ELSE regexp_extract(case_key, '^(\\d+)', 1) END AS core, court_key FROM a""",
    "doc_meta": rf"""
WITH a AS (SELECT rec_no, regexp_extract(regexp_replace(case_number, '\s+', '', 'g'), '^[^/]*/[^/]*/(.*)$', 1) AS s FROM precedents)
SELECT rec_no, {_CASE} AS kind, CASE WHEN contains(s, 'PT') THEN 'phúc thẩm' WHEN contains(s, 'ST') THEN 'sơ thẩm' END AS stage FROM a""",
    "dates_normalize": r"""
WITH a AS (SELECT rec_no, created_at, regexp_extract(full_text, '(\d{1,2}[/.-]\d{1,2}[/.-]\d{4})', 1) AS r FROM precedents),
b AS (SELECT *, string_split_regex(r, '[/.-]') AS p FROM a)
SELECT rec_no, CASE WHEN r IS NULL OR r = '' THEN '' ELSE p[3] || '-' || lpad(p[2], 2, '0') || '-' || lpad(p[1], 2, '0') END AS iso,
 coalesce(strftime(created_at, '%Y-%m-%d'), '') AS created, CASE WHEN r IS NULL OR r = '' THEN r ELSE lpad(p[1], 2, '0') || '/' || lpad(p[2], 2, '0') || '/' || p[3] END AS written FROM b""",
    "article_references": r"""
WITH a AS (SELECT rec_no, full_text, list_transform(regexp_extract_all(full_text, '(?i)Điều\s+(\d+)', 1), lambda x: 'Điều ' || x) AS r FROM precedents)
SELECT rec_no, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), '|') AS refs FROM a""",
    "crime_token_sets": rf"""
SELECT rec_no, CASE WHEN crimes IS NULL THEN NULL ELSE array_to_string(list_sort(list_filter(list_distinct(flatten(list_transform(list_filter(crimes, lambda x: x IS NOT NULL), lambda x: regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}_]+')))), lambda x: x NOT IN ('tội', 'về', 'và', 'các', 'quy', 'định'))), ' ') END AS tokens FROM precedents""",
    "matching_keys": r"""
WITH a AS (SELECT rec_no, array_to_string(list_filter(crimes, lambda x: x IS NOT NULL), '; ') AS c, array_to_string(list_filter(articles, lambda x: x IS NOT NULL), '; ') AS b, facts_summary AS f FROM precedents)
SELECT rec_no, trim('Tội danh: ' || coalesce(nullif(c, ''), '—') || '. Điều luật: ' || coalesce(nullif(b, ''), '—') || '. Tình tiết: ' || coalesce(f, ''), ' ') AS key FROM a""",
    "facts_summary": r"""
WITH a AS (SELECT rec_no, full_text AS t, regexp_extract(full_text, '(?is)^(.*?)NỘI\s*DUNG\s*VỤ\s*ÁN', 1) AS h, regexp_extract(full_text, '(?is)^.*?NỘI\s*DUNG\s*VỤ\s*ÁN', 0) AS hh, regexp_extract(full_text, '(?is)^(.*?)NHẬN\s*ĐỊNH', 1) AS r, regexp_matches(full_text, '(?i)NHẬN\s*ĐỊNH') AS hr FROM precedents),
b AS (SELECT rec_no, CASE WHEN t IS NULL THEN '' WHEN hh <> '' AND hr AND length(r) > length(hh) THEN substr(t, length(hh) + 1, length(r) - length(hh)) WHEN hh <> '' THEN substr(t, length(hh) + 1, 1200) ELSE substr(t, 301, 1200) END AS s FROM a)
SELECT rec_no, substr(trim(regexp_replace(s, '\s+', ' ', 'g'), ' '), 1, 1200) AS facts FROM b""",
    "law_name_keys": r"""
WITH a AS (SELECT DISTINCT law_text, lower(trim(regexp_replace(regexp_replace(regexp_replace(law_text, '^\s+|\s+$', '', 'g'), '\s*(?:năm\s+)?(?:19|20)\d{2}.*$', ''), '\s+', ' ', 'g'), ' ,;.')) AS law_key FROM parsed_citations WHERE law_text IS NOT NULL),
b AS (SELECT *, list_filter(string_split(law_key, ' '), lambda w: w <> '' AND w NOT IN ('của', 'và', 'về', 'số', 'the')) AS w FROM a)
SELECT law_text, law_key, len(w) > 0 AND len(list_filter(w, lambda x: NOT contains('văn bản hợp nhất bộ luật tố tụng hình sự', x))) = 0 AND contains(law_key, 'tố tụng') AS in_procedure_title FROM b""",
    "content_hash_dedup": "SELECT sha1(coalesce(text, '')) AS hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1",
    "token_counts": r"SELECT doc_id, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS INTEGER) AS words, CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS INTEGER) AS tokens FROM documents",
    "sentence_split": r"""
WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?;…])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS ord, unnest(s) AS sentence FROM a""",
    "money_numbers": r"""
WITH a AS (SELECT rec_no, unnest(list_distinct(regexp_extract_all(facts_summary, '(\d{1,3}(?:[.]\d{3})+)(?: đồng|đ)', 1))) AS raw FROM precedents)
SELECT rec_no, raw, CAST(replace(raw, '.', '') AS DOUBLE) AS value FROM a""",
    "crawl_classify": f"""
WITH a AS (SELECT rec_no, lower(coalesce(title, '')) AS t FROM precedents),
b AS (SELECT rec_no, len(list_filter({_LIST(CRIMINAL)}, lambda m: contains(t, m))) > 0 AS criminal, len(list_filter({_LIST(CIVIL)}, lambda m: contains(t, m))) > 0 AS c FROM a)
SELECT rec_no, criminal, NOT criminal AND c AS civil FROM b""",
}
