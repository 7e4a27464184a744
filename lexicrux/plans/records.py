"""Queries of case records, statutes, positions, reports and signs of tampering that need no pattern with look-around."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexicrux.functions import cases as C
from lexicrux.functions import spans as S
from lexicrux.functions import text as T
from lexicrux.operators import evaluate as E
from lexicrux.operators import forgery as G
from lexicrux.operators import jobs as J
from lexicrux.operators import law as L
from lexicrux.operators import windows as W
from lexicrux.plans.spans import _DOCS, _SCAN, _TAG, _TOK, _exploded, _texts
from lexicrux.sources import files as R


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _gold(spark, d):
    """Annotated spans by document: id, label, start, end, text."""
    return _t(spark, d, "gold_spans").select("id", F.posexplode("spans").alias("ord", "s")).where("s IS NOT NULL").select("id", "ord", "s.label", "s.start", "s.end", "s.text")


# texts ---------------------------------------------------------------------------------------------------------------------
def case_kinds(spark, d):
    return _t(spark, d, "precedents").select("rec_no", C.kind_of(F.col("full_text")).alias("kind"))


def facts_sections(spark, d):
    return _t(spark, d, "precedents").where("full_text IS NOT NULL").select("rec_no", C.facts_section(F.col("full_text")).alias("facts"))


def answer_heads(spark, d):
    """What is kept of answers: whether they are useless, without their preamble, and their opening."""
    t = F.col("text")
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", C.useless(t).alias("useless"), C.without_preamble(t).alias("body"), C.opening(t).alias("opening"))


def main_article_refs(spark, d):
    """Main articles of precedents whose text stands behind a heading of the law's section, and of those without, by title."""
    text = F.when(F.col("rec_no") % 2 == 0, F.concat(F.lit("Quy định của pháp luật liên quan: "), F.col("full_text"))).otherwise("")
    return _t(spark, d, "precedents").where("full_text IS NOT NULL AND title IS NOT NULL").select("rec_no", F.array_join(C.main_articles(text, F.col("facts_summary")), "|").alias("articles"))


def metadata_records(spark, d):
    p = _t(spark, d, "precedents").where("title IS NOT NULL")
    x = p.select("rec_no", C.metadata_record(F.col("case_number"), F.col("title"), F.lit("")).alias("r"))
    return x.select("rec_no", "r.case_number", "r.case_type", F.array_join("r.articles", "|").alias("articles"), "r.facts_summary", "r.full_text")


def statute_texts_clean(spark, d):
    return _t(spark, d, "documents").select("doc_id", R.statute_clean(F.col("text")).alias("text"))


def pdf_dates(spark, d):
    """Dates as PDF files write them, read back."""
    o = _t(spark, d, "ocr_results").select("ocr_id", F.concat(F.lit("D:"), F.date_format("finished_at", "yyyyMMddHHmmss"), F.lit("+07'00'")).alias("raw"))
    return o.select("ocr_id", F.date_format(T.pdf_timestamp(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("at"), F.date_format(T.pdf_timestamp(F.substring("raw", 1, 8)), "yyyy-MM-dd").alias("month"))


def request_bodies(spark, d):
    return _t(spark, d, "precedents").where("title IS NOT NULL").select("rec_no", C.request_body(F.lit("x"), "m", F.col("case_type"), F.lit("")).alias("body"))


# records of spans ----------------------------------------------------------------------------------------------------------
def case_records(spark, d):
    """Records of cases out of the annotated spans."""
    r = C.case_record(_texts(spark, d), _gold(spark, d).withColumnRenamed("id", "doc_id"), "doc_id", "text")
    return r.select("doc_id", "court", *(F.array_join(c, "|").alias(c) for c in ("crimes", "articles", "penalties")), "facts_summary", F.length("full_text").alias("chars"))


FACT_LABELS = [("CASE_NUMBER", "Số bản án"), ("COURT", "Tòa án"), ("DEFENDANT", "Bị cáo"), ("CRIME", "Tội danh"), ("PENALTY", "Hình phạt")]


def fact_blocks(spark, d):
    return C.fact_lines(_gold(spark, d), "id", FACT_LABELS)


def gold_positions(spark, d):
    """Where the annotated texts stand: their first and second place in the document."""
    g = _gold(spark, d).where("text IS NOT NULL AND text <> ''").join(_texts(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("whole")), "id")
    at = lambda n: S.occurrence(F.col("whole"), F.col("text"), n)
    return g.select("id", "ord", at(1).alias("first_at"), at(2).alias("second_at"), (F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")).alias("in_place"))


def pattern_report(spark, d):
    """Numbers, articles and clauses found by pattern against the annotated spans: per label, micro and macro, over the labels
    that are annotated at all."""
    t = F.col("text")
    every = F.concat(*(S.matches(t, rx, label) for label, rx, _ in S.PATTERNS if label in ("ARTICLE", "CLAUSE", "CASE_NUMBER")))
    pred = _exploded(_texts(spark, d), "doc_id", every).select("doc_id", "ord", "label", "start", "end")
    gold = _gold(spark, d).select(F.col("id").alias("doc_id"), "ord", "label", "start", "end").join(_texts(spark, d).select("doc_id"), "doc_id", "left_semi")
    own = E.in_gold(gold, pred)
    gold = E.in_gold(pred, gold)
    return E.with_macro(E.prf(E.exact_hits(gold, own, "doc_id"), gold, own))


def section_tokens(spark, d):
    """Token ranges of the sections of the annotated texts."""
    return W.sections_in_tokens(_texts(spark, d), "doc_id", "text", S.sections(F.col("text")))


def subword_alignment(spark, d):
    """Labels of sub-words of about three characters, and where a window of 256 of them ends."""
    tags = W.bio_encode(W.tokenized(_texts(spark, d), "doc_id", "text"), _gold(spark, d).withColumnRenamed("id", "doc_id"), "doc_id")
    rows = tags.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tok", "tag", F.ceil(F.length("token") / 3).cast("int").alias("n")))).alias("t"))
    n, labels = F.transform("t", lambda x: x["n"]), F.transform("t", lambda x: x["tag"])
    return rows.select("doc_id", W.truncated_at(n, 256).alias("cut_at"), W.subword_labels(labels, n).alias("l")).select("doc_id", "cut_at", F.size("l").alias("pieces"), F.size(F.filter("l", lambda x: x == "-100")).alias("ignored"), F.size(F.filter("l", lambda x: F.startswith(x, F.lit("B-")))).alias("begun"))


# statutes ------------------------------------------------------------------------------------------------------------------
def law_aliases(spark, d):
    """Spellings of laws and the registered law each stands for."""
    tags = _t(spark, d, "parsed_citations").select("law").distinct()
    own = tags.select(F.explode(F.array(F.col("law"), F.lower("law"), F.concat(F.lit(" "), F.col("law"), F.lit(" 2015")))).alias("spelling")).distinct()
    key = L.canonical_law(F.col("spelling"))
    return own.select("spelling", key.alias("law_key"), L.law_label(key).alias("label"))


def offence_articles(spark, d):
    c = _t(spark, d, "parsed_citations").where("so_dieu IS NOT NULL").select("law", "so_dieu").distinct()
    key = L.canonical_law(F.col("law"))
    return c.select("law", "so_dieu", L.is_offence(key, F.col("so_dieu"), F.when(F.col("so_dieu") < 20, "phần thứ hai: các tội phạm")).alias("is_offense"))


def severest_penalty(spark, d):
    p = _t(spark, d, "precedents").select("rec_no", L.severest(F.col("penalties")).alias("p"))
    return p.select("rec_no", "p.kind", "p.years")


def _statutes(spark, d):
    p = _t(spark, d, "part")
    n = F.col("p_partkey").cast("int")
    body = F.concat(F.lit("Điều "), n.cast("string"), F.lit(". Tội về "), F.col("p_name"), F.lit("\n1. Bị phạt tù từ 01 năm đến 05 năm:\na) Có tổ chức;\nb) Tái phạm.\n2. Bị phạt tù 20 năm, tù chung thân hoặc tử hình."))
    return p.where("p_partkey > 0").select(F.when(n % 2 == 0, "BLHS2015").otherwise("BLDS2015").alias("law_key"), n.alias("so_dieu"), body.alias("text"))


def statute_store(spark, d):
    """Tables of a store built from statute texts: what each article holds."""
    s = L.statute_store(_statutes(spark, d))
    key = ["law_key", "so_dieu"]
    n = lambda name, c: s[name].groupBy(*key).agg(F.count("*").alias(c))
    x = s["articles"].select(*key, "tieu_de", "is_offense")
    for name, c in (("clauses", "clauses"), ("points", "points"), ("penalty_frames", "frames")):
        x = x.join(n(name, c), key, "left")
    return x.na.fill(0)


# corpus, jobs, files, tampering ---------------------------------------------------------------------------------------------
def corpus_counts(spark, d):
    """What became of the cited articles in a corpus of the registered laws' articles, per judgment."""
    pairs = _t(spark, d, "parsed_citations").where("precedent_id IS NOT NULL AND so_dieu IS NOT NULL AND law_text IS NOT NULL")
    pairs = pairs.select("precedent_id", F.col("cit_id").alias("ord"), F.col("so_dieu").alias("article"), F.col("law_text").alias("law"))
    reg = L.registry(spark)
    hits = reg.select(F.explode(F.sequence(F.lit(1), "articles")).alias("n"), F.concat(F.lit("Văn bản hợp nhất "), F.col("name")).alias("title")).select(F.concat(F.lit("Điều "), F.col("n").cast("string")).alias("article"), "title")
    return C.corpus_counts(C.checked_pairs(pairs, hits, "precedent_id"), "precedent_id")


def recent_jobs(spark, d):
    return J.recent(_t(spark, d, "ocr_results").select("ocr_id", "engine", "finished_at").where("finished_at IS NOT NULL"), "finished_at", "ocr_id").select("ocr_id", "engine")


def file_kinds(spark, d):
    """Kinds of files by their first bytes and text layer, with how many there are of each."""
    head = F.when(F.col("doc_id") % 3 == 0, "%PDF-1.4 ").when(F.col("doc_id") % 3 == 1, "PK\u0003\u0004").otherwise("x")
    f = _t(spark, d, "documents").select(F.encode(head, "UTF-8").alias("content"), F.col("text"))
    f = f.select(R.file_kind(F.col("content"), F.col("text")).alias("kind"), R.is_pdf(F.col("content")).alias("pdf"), R.text_or_null(F.col("text")).isNull().alias("no_text_layer"))
    return f.groupBy("kind", "pdf", "no_text_layer").agg(F.count("*").alias("files"))


def structured_texts(spark, d):
    """Text-bearing nodes of structured documents, in reading order."""
    item = lambda c: F.array(F.struct(F.lit("item").alias("type"), F.lit(2).alias("page number"), F.col(c).alias("content")))
    doc = F.to_json(F.struct(F.array(F.struct(F.lit("heading").alias("type"), F.lit(1).alias("page number"), F.col("title").alias("content"), item("case_type").alias("kids"), item("case_number").alias("list items"))).alias("kids")))
    p = _t(spark, d, "precedents").select("rec_no", F.posexplode(R.structured_blocks(doc)).alias("ord", "b"))
    return p.select("rec_no", "ord", "b.type", "b.page", "b.text")


def _features(spark, d):
    """Features of files by rule from orders: producer, dates, ends of file, marks, images, red regions."""
    k = F.col("o_orderkey")
    made = F.to_timestamp("o_orderdate")
    stamp = lambda days: F.concat(F.lit("D:"), F.date_format(F.date_add(made.cast("date"), days), "yyyyMMdd"), F.lit("000000Z"))
    content = F.concat(F.lit("%PDF-1.4\n"), F.repeat(F.lit("/Prev 12\n%%EOF\n"), (k % 4).cast("int")), F.repeat(F.lit("x"), (k % 5 * 1000).cast("int")))
    marks = F.when(k % 11 == 0, F.array(F.lit("Link"), F.lit("Redact"))).when(k % 11 == 1, F.array(F.lit("Stamp"))).otherwise(F.array(F.lit("Link")))
    return _t(spark, d, "orders").select(
        "o_orderkey", F.when(k % 7 == 0, "Adobe Photoshop 20").otherwise("Writer").alias("producer"), F.lit(None).cast("string").alias("creator"), stamp(F.lit(0)).alias("creation_date"), stamp((k % 9 * 100 - 100).cast("int")).alias("mod_date"),
        G.byte_counts(F.encode(content, "UTF-8")).alias("b"), marks.alias("annots"), (k % 2).cast("int").alias("images"), F.when(k % 6 == 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("seal_pages"),
    ).select("*", "b.*")


def _findings(spark, d):
    f = _features(spark, d)
    return G.metadata_findings(f, "o_orderkey").unionByName(G.annotation_findings(f, "o_orderkey")).unionByName(G.seal_findings(f, "o_orderkey"))


def tamper_findings(spark, d):
    return _findings(spark, d)


def tamper_summary(spark, d):
    return G.summarised(_findings(spark, d), "o_orderkey").select("o_orderkey", "score", "level", "findings", F.array_join("top", ", ").alias("top"))


QUERIES = {
    f.__name__: f
    for f in (case_kinds, facts_sections, answer_heads, main_article_refs, metadata_records, statute_texts_clean, pdf_dates, request_bodies, case_records, fact_blocks, gold_positions, pattern_report, section_tokens, subword_alignment, law_aliases, offence_articles, severest_penalty, statute_store, corpus_counts, recent_jobs, file_kinds, structured_texts, tamper_findings, tamper_summary)
}

_KINDS = lambda c: "CASE " + " ".join(f"WHEN contains(lower({c}), '{m}') THEN '{n}'" for m, n in C.KINDS) + " ELSE '' END"
_REFS = lambda c: f"array_to_string(list_transform(list_filter(regexp_extract_all({c}, '(?i)điều\\s+(\\d+)', 1), lambda x, i: list_position(regexp_extract_all({c}, '(?i)điều\\s+(\\d+)', 1), x) = i), lambda x: 'Điều ' || x), '|')"
_BETWEEN = lambda c: rf"""CASE WHEN {c} IS NULL THEN '' ELSE (SELECT substr(trim(regexp_replace(CASE WHEN h <> '' AND regexp_matches(tail, '(?i)nhận\s*định') AND length(regexp_extract(tail, '(?is)^(.*?)nhận\s*định', 1)) > 0 THEN regexp_extract(tail, '(?is)^(.*?)nhận\s*định', 1) WHEN h <> '' THEN substr(tail, 1, 1200) ELSE substr({c}, 301, 1200) END, '\s+', ' ', 'g'), ' '), 1, 1200) FROM (SELECT h, substr({c}, length(h) + 1) AS tail FROM (SELECT regexp_extract({c}, '(?is)^.*?nội\s*dung\s*vụ\s*án', 0) AS h))) END"""
_SPANS = "sp AS (SELECT id, unnest(spans) AS s, generate_subscripts(spans, 1) - 1 AS ord FROM gold_spans)"
_FIRST = "ft AS (SELECT id, s.label AS label, trim(s.text, ' ') AS t, min(s.start) AS p FROM sp WHERE trim(s.text, ' ') <> '' GROUP BY ALL), fr AS (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY p) AS r FROM ft)"
_RX = {"ARTICLE": r"[Đđ]iều\s+\d+[a-zđ]?\b", "CLAUSE": r"[Kk]hoản\s+\d+\b", "CASE_NUMBER": r"\b\d{1,4}\s*/\s*\d{4}/[A-ZĐ][A-ZĐ0-9]*(?:\s*-\s*[A-ZĐ][A-ZĐ0-9]*)*"}
_PEN = r"""
p AS (SELECT rec_no, unnest(penalties) AS t, generate_subscripts(penalties, 1) AS ord FROM precedents),
y AS (SELECT rec_no, ord, CASE WHEN regexp_matches(t, '(?i)tử\s*hình') THEN 'tu_hinh' WHEN regexp_matches(t, '(?i)chung\s*thân') THEN 'tu_chung_than' WHEN NOT contains(lower(t), 'tù') THEN NULL WHEN regexp_matches(t, '(?i)\d\s*(năm|tháng)') THEN 'tu_co_thoi_han' END AS kind,
 TRY_CAST(regexp_extract(t, '(?i)0*(\d{1,3})\s*năm', 1) AS INTEGER) AS ny, TRY_CAST(regexp_extract(t, '(?i)0*(\d{1,2})\s*tháng', 1) AS INTEGER) AS nm FROM p WHERE t IS NOT NULL),
z AS (SELECT rec_no, ord, kind, CASE WHEN kind = 'tu_co_thoi_han' THEN round(coalesce(ny, 0) + coalesce(nm, 0) / 12.0, 3) END AS years FROM y WHERE kind IS NOT NULL)"""
_FEATURES = """
f AS (SELECT o_orderkey AS k, CAST(o_orderkey % 9 * 100 - 100 AS INTEGER) AS days, o_orderkey % 4 AS eof, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 5 * 1000 END AS tb FROM orders),
g AS (SELECT k AS o_orderkey, 'metadata.producer' AS signal, 'high' AS severity FROM f WHERE k % 7 = 0
 UNION ALL SELECT k, 'metadata.dates_reversed', 'medium' FROM f WHERE days < 0 UNION ALL SELECT k, 'metadata.late_change', 'low' FROM f WHERE days >= 365
 UNION ALL SELECT k, 'incremental.updates', CASE WHEN eof <= 2 THEN 'medium' ELSE 'high' END FROM f WHERE eof > 1 UNION ALL SELECT k, 'incremental.trailing_bytes', 'medium' FROM f WHERE tb >= 2048
 UNION ALL SELECT k, 'annotation.editing_artifacts', CASE WHEN k % 11 = 0 THEN 'high' ELSE 'medium' END FROM f WHERE k % 11 < 2 UNION ALL SELECT k, 'seal.absent_low_confidence', 'low' FROM f WHERE k % 2 = 1 AND k % 6 <> 1)"""
_SECT = r"""
s1 AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, 'NHÂN\s+DANH') THEN length(regexp_extract(text, '(?s)^(.*?)NHÂN\s+DANH', 1)) END AS p1 FROM t),
s2 AS (SELECT *, coalesce(p1, 0) AS c1 FROM s1), s3 AS (SELECT *, CASE WHEN regexp_matches(substr(text, c1 + 1), 'NỘI\s+DUNG\s+VỤ\s+ÁN') THEN c1 + length(regexp_extract(substr(text, c1 + 1), '(?s)^(.*?)NỘI\s+DUNG\s+VỤ\s+ÁN', 1)) END AS p2 FROM s2),
s4 AS (SELECT *, coalesce(p2, c1) AS c2 FROM s3), s5 AS (SELECT *, CASE WHEN regexp_matches(substr(text, c2 + 1), 'NHẬN\s+ĐỊNH') THEN c2 + length(regexp_extract(substr(text, c2 + 1), '(?s)^(.*?)NHẬN\s+ĐỊNH', 1)) END AS p3 FROM s4),
s6 AS (SELECT *, coalesce(p3, c2) AS c3 FROM s5), s7 AS (SELECT *, CASE WHEN regexp_matches(substr(text, c3 + 1), 'QUYẾT\s+ĐỊNH') THEN c3 + length(regexp_extract(substr(text, c3 + 1), '(?s)^(.*)QUYẾT\s+ĐỊNH', 1)) WHEN regexp_matches(text, 'QUYẾT\s+ĐỊNH') THEN length(regexp_extract(text, '(?s)^(.*)QUYẾT\s+ĐỊNH', 1)) END AS p4 FROM s6),
mk AS (SELECT doc_id, text, unnest(list_filter([{'n': 'NHAN_DANH', 'p': p1}, {'n': 'NOI_DUNG', 'p': p2}, {'n': 'NHAN_DINH', 'p': p3}, {'n': 'QUYET_DINH', 'p': p4}], lambda x: x.p IS NOT NULL)) AS m, generate_subscripts(list_filter([{'n': 'NHAN_DANH', 'p': p1}, {'n': 'NOI_DUNG', 'p': p2}, {'n': 'NHAN_DINH', 'p': p3}, {'n': 'QUYET_DINH', 'p': p4}], lambda x: x.p IS NOT NULL), 1) AS i FROM s7),
al AS (SELECT doc_id, text, m.n AS name, m.p AS a, i FROM mk UNION ALL SELECT doc_id, text, 'PREAMBLE', 0, 0 FROM s7 WHERE coalesce(p1, p2, p3, p4, 1) > 0),
sec AS (SELECT doc_id, name, a, coalesce(lead(a) OVER w, length(text)) AS b, lead(a) OVER w AS nx, row_number() OVER w - 1 AS ord, lead(a) OVER w IS NULL AS last FROM al WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""
SQL = {
    "case_kinds": f"SELECT rec_no, {_KINDS('full_text')} AS kind FROM precedents",
    "facts_sections": r"""
WITH a AS (SELECT rec_no, full_text AS t, regexp_extract(full_text, '(?is)^.*?nội\s*dung\s*vụ\s*án', 0) AS h FROM precedents WHERE full_text IS NOT NULL), b AS (SELECT *, substr(t, length(h) + 1) AS tail FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)nhận\s*định') THEN length(regexp_extract(t, '(?is)^(.*?)nhận\s*định', 1)) END AS e FROM b)
SELECT rec_no, substr(regexp_replace(CASE WHEN h <> '' AND e > length(h) THEN substr(tail, 1, e - length(h)) WHEN h <> '' THEN substr(tail, 1, 4000) ELSE substr(t, 401, 3600) END, '^[ :\n\t]+|[ :\n\t]+$', '', 'g'), 1, 4000) AS facts FROM c""",
    "answer_heads": r"""
WITH a AS (SELECT doc_id, text, trim(text, ' ') AS x, substr(text, 1, 120) AS h FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, string_split(regexp_replace(x, '([.:])\s+', '\1' || chr(1), 'g'), chr(1)) AS ps, substr(trim(regexp_replace(trim(regexp_replace(text, '(?is)^.*?như sau\s*:?', ''), ' '), '\s{2,}', ' ', 'g'), ' '), 1, 320) AS o FROM a),
c AS (SELECT *, list_position(list_transform(ps, lambda p: NOT list_bool_or(list_transform(['bạn ', 'dưới đây', 'tóm tắt', 'yêu cầu', 'tôi hiểu', 'tôi sẽ', 'như sau', 'sự việc'], lambda m: contains(lower(p), m)))), true) AS i FROM b)
SELECT doc_id, contains(h, 'Xin chào! Tôi là') OR contains(h, 'trợ lý tư vấn pháp luật Việt Nam') OR contains(h, 'Báo cáo kiểm tra') AS useless,
 CASE WHEN coalesce(i, 0) = 0 OR trim(array_to_string(ps[i:], ' '), ' ') = '' THEN x ELSE trim(array_to_string(ps[i:], ' '), ' ') END AS body, trim(CASE WHEN regexp_matches(o, '(?s)^.{140,}\. ') THEN regexp_extract(o, '(?s)^(.{140,}\.) ', 1) ELSE o END, ' ') AS opening FROM c""",
    "main_article_refs": rf"""
WITH a AS (SELECT rec_no, facts_summary AS f, CASE WHEN rec_no % 2 = 0 THEN string_split_regex(substr(' ' || full_text, 1, 600), 'T[ừu]\s*kh[óo]a|N[Ộộ]I\s*DUNG|NH[Ậậ]N\s*[Đđ]|\n\s*\n')[1] ELSE '' END AS s FROM precedents WHERE full_text IS NOT NULL AND title IS NOT NULL),
b AS (SELECT rec_no, {_REFS('s')} AS own, {_REFS('f')} AS other FROM a) SELECT rec_no, CASE WHEN own <> '' THEN array_to_string(string_split(own, '|')[1:8], '|') ELSE other END AS articles FROM b""",
    "metadata_records": rf"SELECT rec_no, case_number, {_KINDS('title')} AS case_type, {_REFS('title')} AS articles, coalesce(nullif(trim(title, '. '), ''), title) AS facts_summary, title AS full_text FROM precedents WHERE title IS NOT NULL",
    "statute_texts_clean": "SELECT doc_id, nfc_normalize(replace(replace(text, chr(160), ' '), chr(8203), '')) AS text FROM documents",
    "pdf_dates": "SELECT ocr_id, strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS at, strftime(date_trunc('month', finished_at), '%Y-%m-%d') AS month FROM ocr_results",
    "request_bodies": """SELECT rec_no, '{"model":"m","messages":[{"role":"user","content":"x"}],"stream":false,"temperature":0.2,"skip_router":true' || CASE WHEN coalesce(case_type, '') <> '' THEN ',"search_query":' || to_json(case_type) ELSE '' END || '}' AS body FROM precedents WHERE title IS NOT NULL""",
    "case_records": f"""
WITH {_DOCS}, {_SPANS}, {_FIRST},
ag AS (SELECT id, label, list(t ORDER BY r) AS ts FROM fr WHERE r <= 20 GROUP BY ALL), g AS (SELECT doc_id, text, max(ts) FILTER (label = 'COURT') AS co, max(ts) FILTER (label = 'CRIME') AS cr, max(ts) FILTER (label = 'ARTICLE') AS ar, max(ts) FILTER (label = 'LEGAL_BASIS') AS lb, max(ts) FILTER (label = 'PENALTY') AS pe FROM t LEFT JOIN ag ON doc_id = id GROUP BY ALL),
h AS (SELECT *, array_to_string(coalesce(ar, [])[1:20], ' ') || ' ' || array_to_string(coalesce(lb, [])[1:8], ' ') AS cited FROM g)
SELECT doc_id, coalesce(co[1], '') AS court, array_to_string(coalesce(cr, [])[1:8], '|') AS crimes, {_REFS('cited')} AS articles, array_to_string(coalesce(pe, [])[1:6], '|') AS penalties, {_BETWEEN('text')} AS facts_summary, CAST(length(text) AS INTEGER) AS chars FROM h""",
    "fact_blocks": f"""
WITH {_SPANS}, {_FIRST}, n(label, shown, o) AS (VALUES {', '.join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(FACT_LABELS))}),
l AS (SELECT id, label, string_agg(t, '; ' ORDER BY r) AS ts FROM fr WHERE r <= 8 GROUP BY ALL) SELECT id, string_agg('- ' || coalesce(shown, l.label) || ': ' || ts, chr(10) ORDER BY coalesce(o, {len(FACT_LABELS)}), l.label) AS facts FROM l LEFT JOIN n USING (label) GROUP BY id""",
    "gold_positions": f"""
WITH {_DOCS}, {_SPANS}, x AS (SELECT id, ord, s.text AS p, s.start AS a, s."end" AS b, text, instr(text, s.text) AS f FROM sp JOIN t ON id = doc_id WHERE s.text <> ''), y AS (SELECT *, instr(substr(text, f + 1), p) AS g FROM x)
SELECT id, CAST(ord AS INTEGER) AS ord, CAST(CASE WHEN f > 0 THEN f - 1 END AS INTEGER) AS first_at, CAST(CASE WHEN f > 0 AND g > 0 THEN f + g - 1 END AS INTEGER) AS second_at, substr(text, a + 1, b - a) = p AS in_place FROM y""",
    "pattern_report": f"WITH {_DOCS}, a AS (" + " UNION ALL ".join(f"SELECT '{label}' AS label, * FROM ({_SCAN('t', 'doc_id', 'text', rx)})" for label, rx in _RX.items()) + f"""),
b AS (SELECT doc_id, label, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, label ORDER BY i) AS e, length(m) AS n FROM a), pr AS (SELECT doc_id, label, e - n AS s, e FROM b), {_SPANS},
go AS (SELECT id AS doc_id, s.label AS label, s.start AS s, s."end" AS e FROM sp WHERE id IN (SELECT doc_id FROM t) AND s.label IN (SELECT label FROM pr)), pg AS (SELECT * FROM pr WHERE label IN (SELECT s.label FROM sp WHERE id IN (SELECT doc_id FROM t))),
gn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, s, e) AS r FROM go), pn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, s, e) AS r FROM pg), hit AS (SELECT label, count(*) AS tp FROM gn JOIN pn USING (doc_id, label, s, e, r) GROUP BY label),
c AS (SELECT coalesce(g.label, p.label) AS label, coalesce(hit.tp, 0) AS tp, coalesce(g.n, 0) AS gold, coalesce(p.n, 0) AS pred FROM (SELECT label, count(*) AS n FROM go GROUP BY label) g FULL JOIN (SELECT label, count(*) AS n FROM pg GROUP BY label) p ON g.label = p.label LEFT JOIN hit ON hit.label = coalesce(g.label, p.label)),
v AS (SELECT * FROM c UNION ALL SELECT 'micro', sum(tp), sum(gold), sum(pred) FROM c), w AS (SELECT *, CASE WHEN pred = 0 THEN 0.0 ELSE tp / pred END AS p, CASE WHEN gold = 0 THEN 0.0 ELSE tp / gold END AS r FROM v),
f AS (SELECT label, CAST(tp AS BIGINT) AS tp, CAST(gold AS BIGINT) AS gold, CAST(pred AS BIGINT) AS pred, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM w)
SELECT * FROM f UNION ALL SELECT 'macro', CAST(sum(tp) AS BIGINT), CAST(sum(gold) AS BIGINT), CAST(sum(pred) AS BIGINT), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM f WHERE label <> 'micro'""",
    "section_tokens": f"WITH {_DOCS}, {_TOK}, {_SECT} SELECT tokens.doc_id, CAST(ord AS INTEGER) AS ord, name, CAST(min(tok) AS INTEGER) AS lo, CAST(max(tok) + 1 AS INTEGER) AS hi FROM tokens JOIN sec ON tokens.doc_id = sec.doc_id AND s >= a AND s < coalesce(nx, 2147483647) GROUP BY ALL",
    "subword_alignment": f"""
WITH {_DOCS}, {_TOK}, {_TAG}, u AS (SELECT tokens.doc_id, tokens.tok, CAST(ceil(length(tokens.token) / 3.0) AS BIGINT) AS n, coalesce(tag.tag, 'O') AS tag FROM tokens LEFT JOIN tag ON tokens.doc_id = tag.doc_id AND tokens.tok = tag.tok), v AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY tok) AS used FROM u)
SELECT doc_id, CAST(min(tok) FILTER (used > 256) AS INTEGER) AS cut_at, CAST(sum(n) AS INTEGER) AS pieces, CAST(sum(n) - count(*) AS INTEGER) AS ignored, CAST(count(*) FILTER (tag[1:2] = 'B-') AS INTEGER) AS begun FROM v GROUP BY doc_id""",
    "law_aliases": """
WITH a AS (SELECT DISTINCT law FROM parsed_citations), b AS (SELECT DISTINCT unnest([law, lower(law), ' ' || law || ' 2015']) AS spelling FROM a),
c AS (SELECT spelling, replace(upper(trim(spelling)), ' ', '') AS k FROM b), r AS (SELECT spelling, CASE k WHEN 'BLTTHS' THEN 'BLTTHS2015' WHEN 'BLTTHS2015' THEN 'BLTTHS2015' WHEN 'BLDS' THEN 'BLDS2015' WHEN 'BLDS2015' THEN 'BLDS2015' ELSE 'BLHS2015' END AS law_key FROM c)
SELECT spelling, law_key, CASE law_key WHEN 'BLTTHS2015' THEN 'Bộ luật Tố tụng hình sự 2015 (101/2015/QH13)' WHEN 'BLDS2015' THEN 'Bộ luật Dân sự 2015 (91/2015/QH13)' ELSE 'Bộ luật Hình sự 2015 (100/2015/QH13)' END AS label FROM r""",
    "offence_articles": "SELECT DISTINCT law, so_dieu, coalesce(law, '') NOT IN ('BLTTHS', 'BLDS') AND (so_dieu < 20 OR so_dieu BETWEEN 108 AND 425) AS is_offense FROM parsed_citations WHERE so_dieu IS NOT NULL",
    "severest_penalty": f"WITH {_PEN}, q AS (SELECT *, row_number() OVER (PARTITION BY rec_no ORDER BY CASE kind WHEN 'tu_hinh' THEN 3 WHEN 'tu_chung_than' THEN 2 ELSE 1 END DESC, coalesce(years, 0) DESC, ord) AS r FROM z) SELECT p.rec_no, kind, years FROM precedents p LEFT JOIN q ON p.rec_no = q.rec_no AND r = 1",
    "statute_store": "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'BLHS2015' ELSE 'BLDS2015' END AS law_key, CAST(p_partkey AS INTEGER) AS so_dieu, 'Tội về ' || p_name AS tieu_de, p_partkey % 2 = 0 AND p_partkey BETWEEN 108 AND 425 AS is_offense, CAST(2 AS BIGINT) AS clauses, CAST(2 AS BIGINT) AS points, CAST(4 AS BIGINT) AS frames FROM part WHERE p_partkey > 0",
    "corpus_counts": r"""
WITH p AS (SELECT precedent_id, so_dieu, law_text, lower(trim(regexp_replace(regexp_replace(trim(law_text), '\s*(?:năm\s+)?(?:19|20)\d{2}.*$', ''), '\s+', ' ', 'g'), ' ,;.')) AS k FROM parsed_citations WHERE precedent_id IS NOT NULL AND so_dieu IS NOT NULL AND law_text IS NOT NULL),
h AS (SELECT * FROM (VALUES ('bộ luật hình sự', 426), ('bộ luật tố tụng hình sự', 510), ('bộ luật dân sự', 689), ('nghị quyết về án phí, lệ phí tòa án', 48)) t(name, n)),
w AS (SELECT *, list_filter(string_split(k, ' '), lambda x: x <> '' AND x NOT IN ('của', 'và', 'về', 'số', 'the')) AS ws FROM p),
c AS (SELECT precedent_id, EXISTS (SELECT 1 FROM h WHERE so_dieu BETWEEN 1 AND n AND len(ws) > 0 AND len(list_filter(ws, lambda x: NOT contains('văn bản hợp nhất ' || name, x))) = 0 AND contains(name, 'tố tụng') = contains(k, 'tố tụng')) AS f FROM w)
SELECT precedent_id, 'ok' AS status, count(*) AS checked, count(*) FILTER (f) AS found, count(*) FILTER (NOT f) AS not_found FROM c GROUP BY precedent_id""",
    "recent_jobs": "SELECT ocr_id, engine FROM ocr_results WHERE finished_at IS NOT NULL ORDER BY finished_at DESC, ocr_id LIMIT 50",
    "file_kinds": r"""
WITH a AS (SELECT CASE WHEN doc_id % 3 = 0 THEN CASE WHEN length(trim(text, ' ')) > 400 THEN 'pdf-text' ELSE 'scan' END WHEN doc_id % 3 = 1 THEN CASE WHEN text IS NULL THEN 'docx-fail' ELSE 'docx' END ELSE 'unknown' END AS kind, doc_id % 3 = 0 AS pdf, coalesce(length(regexp_replace(text, '\s+', '', 'g')), 0) < 200 AS no_text_layer FROM documents)
SELECT kind, pdf, no_text_layer, count(*) AS files FROM a GROUP BY ALL""",
    "structured_texts": """
WITH a AS (SELECT rec_no, unnest([{'o': 0, 'y': 'heading', 'p': 1, 't': title}, {'o': 1, 'y': 'item', 'p': 2, 't': case_number}, {'o': 2, 'y': 'item', 'p': 2, 't': case_type}]) AS x FROM precedents), b AS (SELECT rec_no, x.o AS o, x.y AS type, x.p AS page, trim(x.t, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM a)
SELECT rec_no, CAST(row_number() OVER (PARTITION BY rec_no ORDER BY o) - 1 AS INTEGER) AS ord, type, page, text FROM b WHERE text <> ''""",
    "tamper_findings": f"WITH {_FEATURES} SELECT * FROM g",
    "tamper_summary": f"""
WITH {_FEATURES}, w AS (SELECT *, CASE severity WHEN 'high' THEN 40 WHEN 'medium' THEN 20 ELSE 5 END AS w FROM g), s AS (SELECT o_orderkey, CAST(least(100, sum(w)) AS INTEGER) AS score, bool_or(severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) AS findings, array_to_string(list_slice(list(signal ORDER BY w DESC, signal), 1, 3), ', ') AS top FROM w GROUP BY o_orderkey)
SELECT o_orderkey, score, CASE WHEN h AND (score >= 50 OR m >= 1) THEN 'high' WHEN h OR m >= 2 OR score >= 35 THEN 'medium' ELSE 'low' END AS level, findings, top FROM s""",
}
