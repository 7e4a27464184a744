"""Queries of statutes, citations, existence, tampering, evaluation and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexicrux.functions import text as T
from lexicrux.operators import citations as C
from lexicrux.operators import evaluate as E
from lexicrux.operators import existence as X
from lexicrux.operators import forgery as G
from lexicrux.operators import jobs as J
from lexicrux.operators import law as L
from lexicrux.plans.spans import _texts, entity_spans


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _dims(spark):
    """A statute dimension by rule: articles 1..426 of each law, article n with n % 7 + 1 clauses, clause k with k % 4 points."""
    a = L.registry(spark).where("law_key <> 'NQ326_2016'").select("law_key", F.explode(F.sequence(F.lit(1), F.lit(426))).alias("so_dieu"))
    c = a.select("law_key", "so_dieu", F.explode(F.sequence(F.lit(1), F.col("so_dieu") % 7 + 1)).alias("so_khoan"))
    p = c.where("so_khoan % 4 > 0").select("law_key", "so_dieu", "so_khoan", F.explode(F.slice(F.array(*map(F.lit, "abc")), F.lit(1), F.col("so_khoan") % 4)).alias("ky_hieu"))
    return a, c, p


def _keyed(df):
    k = F.create_map(*[F.lit(x) for kv in L.TAG_TO_KEY.items() for x in kv])
    return df.withColumn("law_key", k[F.col("law")])


def law_classify(spark, d):
    c = _t(spark, d, "parsed_citations").where("raw IS NOT NULL").select(F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit(r"\d ((?:của )?(?:Bộ luật|Luật|Nghị quyết)[^;,|/\n\t•]*)"), F.lit(1)))).alias("law_text")).distinct()
    return c.select("law_text", L.law_tag(F.col("law_text")).alias("law"))


def citation_parse(spark, d):
    return C.citations(_t(spark, d, "parsed_citations").select("cit_id", "raw"), "raw").drop("raw")


def citation_first(spark, d):
    """Article and clause of each field's first citation."""
    return citation_parse(spark, d).where("ord = 0").select("cit_id", "so_dieu", "so_khoan").distinct()


def _cited(spark, d):
    return _keyed(_t(spark, d, "parsed_citations").where("so_dieu IS NOT NULL").select("cit_id", "so_dieu", "so_khoan", "diem", "law")).where("law_key IS NOT NULL")


def citation_verify(spark, d):
    return L.verify(_cited(spark, d), *_dims(spark)).select("cit_id", "law_key", "level")


def citation_report(spark, d):
    """Counts of what became of all citations, per law."""
    own = _t(spark, d, "parsed_citations").select("cit_id", "so_dieu", "so_khoan", "diem", "law")
    level = L.verify(_keyed(own), *_dims(spark))
    status = F.when(F.col("so_dieu").isNull(), "unparseable").when(F.col("law_key").isNull(), "out_of_scope").when(F.col("level") == "found", "valid").otherwise("not_found")
    s = level.withColumn("status", status)
    return s.groupBy("law").agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == x).alias(x) for x in ("valid", "not_found", "out_of_scope", "unparseable")))


def citation_reattach(spark, d):
    """Where the citations that the statutes don't hold may belong."""
    cits = _keyed(citation_parse(spark, d)).where("law_key IS NOT NULL").withColumn("chain", F.lit(0))
    a, c, p = _dims(spark)
    missing = L.verify(cits, a, c, p).where("level <> 'found'").select("cit_id", "chain", "law_key", "so_dieu", "so_khoan", "diem").distinct()
    held = c.withColumn("diem", F.lit(None).cast("string")).unionByName(p.withColumnRenamed("ky_hieu", "diem"))
    return C.reattached(missing, cits, held, "cit_id")


def citation_spans(spark, d):
    """Citations put together from separate spans of the labeller, the first of each kept."""
    c = C.reconstructed(entity_spans(spark, d), "doc_id")
    return C.first_of_each(c, "doc_id", ["chain", "start"])


def law_article_lookup(spark, d):
    """Each article with its clauses and the number of their points, nested."""
    a, c, p = _dims(spark)
    n = p.groupBy("law_key", "so_dieu", "so_khoan").agg(F.count("*").alias("points"))
    nested = c.join(n, ["law_key", "so_dieu", "so_khoan"], "left").groupBy("law_key", "so_dieu").agg(F.array_sort(F.collect_list(F.struct("so_khoan", F.coalesce("points", F.lit(0)).alias("points")))).alias("clauses"))
    return a.join(nested, ["law_key", "so_dieu"], "left").select("law_key", "so_dieu", F.size("clauses").alias("clauses"), F.aggregate("clauses", F.lit(0).cast("bigint"), lambda s, x: s + x["points"]).alias("points"))


def validity_at_date(spark, d):
    reg = L.registry(spark).withColumn("no", F.row_number().over(_order("law_key")))
    o = _t(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("on"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("no"))
    o = o.withColumn("on", F.add_months("on", 252))
    return o.join(F.broadcast(reg), "no").select("o_orderkey", "law_key", L.in_force(F.col("on"), F.col("effective_from"), F.col("effective_to")).alias("in_force"))


def _order(c):
    from pyspark.sql import Window

    return Window.orderBy(c)


def _penalties(spark, d):
    return _t(spark, d, "precedents").select("rec_no", F.posexplode("penalties").alias("ord", "penalty")).where("penalty IS NOT NULL")


def penalty_parse(spark, d):
    p = _penalties(spark, d).select("rec_no", "ord", L.pronounced(F.col("penalty")).alias("p"))
    return p.select("rec_no", "ord", "p.kind", "p.years")


def _statutes(spark, d):
    """Statute texts by rule from parts: numbered clauses with points, a range of prison, fines, life."""
    p = _t(spark, d, "part").where("p_partkey > 0")
    n = F.col("p_partkey").cast("int")
    text = F.concat(
        F.lit("Điều "), n.cast("string"), F.lit(". Tội số "), n.cast("string"), F.lit("\n1. Người nào làm việc này thì bị phạt tù từ "), F.lpad((n % 3 + 1).cast("string"), 2, "0"), F.lit(" năm đến "), (n % 3 + 5).cast("string"), F.lit(" năm:\na) Có tổ chức;\nb) Tái phạm;\ntheo luật định.\n2. Bị phạt tiền từ "),
        (n % 9 + 1).cast("string"), F.lit("0.000.000 đồng đến 100.000.000 đồng hoặc phạt tù 20 năm, tù chung thân.\n2. Khoản viết hai lần.\n3. Cải tạo không giam giữ đến 06 tháng."),
    )
    return p.select(F.lit("X").alias("law_key"), n.alias("so_dieu"), text.alias("text"))


def statute_clauses(spark, d):
    return L.clauses(_statutes(spark, d)).select("so_dieu", "so_khoan", F.size("points").alias("points"), F.length("noi_dung").alias("chars"))


def penalty_frame_parse(spark, d):
    c = L.clauses(_statutes(spark, d)).select("so_dieu", "so_khoan", F.posexplode(L.penalty_frames(F.col("noi_dung"))).alias("ord", "f"))
    return c.select("so_dieu", "so_khoan", "ord", "f.kind", "f.min", "f.max", "f.unit")


def sentencing_frame_check(spark, d):
    """Pronounced penalties against a frame by rule: rec_no % 3 + 1 to rec_no % 5 + 6 years."""
    f = F.array(F.struct(F.lit("tu_co_thoi_han").alias("kind"), (F.col("rec_no") % 3 + 1).cast("double").alias("min"), (F.col("rec_no") % 5 + 6).cast("double").alias("max"), F.lit("nam").alias("unit")))
    p = penalty_parse(spark, d).where("kind IS NOT NULL")
    return p.select("rec_no", "ord", L.sentencing(F.col("kind"), F.col("years"), f).alias("status"))


def charge_match(spark, d):
    p = _t(spark, d, "precedents").select("rec_no", F.posexplode("crimes").alias("ord", "crime"), F.regexp_extract("title", r"về (tội .*)$", 1).alias("name")).where("crime IS NOT NULL")
    return p.select("rec_no", "ord", L.charge_match(F.col("crime"), F.col("name")).alias("match"))


def _numbered(spark, d):
    return _t(spark, d, "precedents").select("rec_no", "case_number", "court", F.regexp_extract("full_text", r"(\d{1,2}/\d{1,2}/\d{4})", 1).alias("date"))


def existence_score(spark, d):
    """Every precedent as a query against all precedents."""
    p = _numbered(spark, d)
    return X.scored(p.withColumnRenamed("rec_no", "q"), p.withColumnRenamed("rec_no", "c")).where("score >= 0.6")


def existence_report(spark, d):
    """What became of every precedent as a query; dates, numbers and courts are joined in place of pairs of records."""
    p = _numbered(spark, d)
    return X.best_reports(p.withColumnRenamed("rec_no", "q"), p.withColumnRenamed("rec_no", "c"))


def forgery_risk_score(spark, d):
    sev = F.when(F.col("event_type") == "error", "high").when(F.col("event_type").isin("purchase", "signup"), "medium").otherwise("low")
    f = _t(spark, d, "events").where("user_id IS NOT NULL").select("user_id", (F.col("event_id") % 97).alias("doc"), sev.alias("severity"))
    return G.risk(f.withColumn("key", F.concat_ws("-", "user_id", "doc")), "key")


def font_outlier(spark, d):
    pages = _t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page"), (F.col("l_suppkey") % 5).alias("font"))
    return G.font_outliers(pages, "l_orderkey", "page", "font")


def dimension_outlier(spark, d):
    pages = _t(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("page")).agg(F.min("l_returnflag").alias("flag"))
    return G.odd_pages(pages, "l_orderkey", "page", ["flag"])


def ocr_statistics(spark, d):
    o = _t(spark, d, "ocr_results")
    low = F.size(F.filter("per_page", lambda x: x["mean_confidence"] < 0.6))
    return o.groupBy("engine").agg(F.count("*").alias("n"), F.round(F.avg("mean_confidence"), 6).alias("confidence"), F.sum("skipped_pages").alias("skipped"), F.sum(F.greatest(low, F.lit(0))).alias("low_pages"), F.sum("quality_warnings").alias("warnings"))


def _gold(spark, d):
    """Annotated spans of every label, of the records that have a text."""
    g = _t(spark, d, "gold_spans").select(F.col("id").alias("doc_id"), F.posexplode("spans").alias("ord", "s")).select("doc_id", "ord", "s.label", "s.start", "s.end")
    return g.join(_texts(spark, d).select("doc_id"), "doc_id", "left_semi")


def _predicted(spark, d):
    """Spans of the default labeller, all its labels; of records that aren't in gold_spans none count."""
    known = _t(spark, d, "gold_spans").select(F.col("id").alias("doc_id"))
    return entity_spans(spark, d).select("doc_id", "ord", "label", "start", "end").join(known, "doc_id", "left_semi")


def span_prf(spark, d):
    g, p = _gold(spark, d), _predicted(spark, d)
    return E.prf(E.exact_hits(g, p, "doc_id"), g, p)


def span_prf_overlap(spark, d):
    g, p = _gold(spark, d), _predicted(spark, d)
    return E.prf(E.overlap_hits(g, p, "doc_id"), g, p)


def train_dev_split(spark, d):
    return E.split(_t(spark, d, "documents").select("doc_id"), "doc_id")


def job_state_latest(spark, d):
    return J.latest(_t(spark, d, "events"), "user_id", "event_id", "event_type")


def resume_anti_join(spark, d):
    """Precedents that no recogniser has delivered yet."""
    done = _t(spark, d, "ocr_results").where("precedent_id IS NOT NULL").select(F.col("precedent_id").alias("id"))
    return J.to_do(_t(spark, d, "precedents").select("id", "rec_no"), done, "id").select("rec_no")


def coverage_report(spark, d):
    have = _keyed(_t(spark, d, "parsed_citations").select("so_dieu", "law")).where("law_key IS NOT NULL AND so_dieu IS NOT NULL")
    c = J.coverage(have, L.registry(spark).select("law_key", "articles"), "law_key", "so_dieu", "articles")
    return c.select("law_key", "have", "expected", "percent", F.size("missing").alias("missing"))


QUERIES = {
    f.__name__: f
    for f in (law_classify, citation_parse, citation_first, citation_verify, citation_report, citation_reattach, citation_spans, law_article_lookup, validity_at_date, penalty_parse, statute_clauses, penalty_frame_parse, sentencing_frame_check, charge_match, existence_score, existence_report, forgery_risk_score, font_outlier, dimension_outlier, ocr_statistics, span_prf, span_prf_overlap, train_dev_split, job_state_latest, resume_anti_join, coverage_report)
}
_KEY = "CASE law WHEN 'BLHS' THEN 'BLHS2015' WHEN 'BLTTHS' THEN 'BLTTHS2015' WHEN 'BLDS' THEN 'BLDS2015' END"
_VERIFY = f"""
c AS (SELECT cit_id, so_dieu, so_khoan, diem, law, {_KEY} AS law_key FROM parsed_citations),
v AS (SELECT *, CASE WHEN law_key IS NULL OR so_dieu IS NULL OR so_dieu NOT BETWEEN 1 AND 426 THEN 'no_dieu' WHEN so_khoan IS NOT NULL AND so_khoan NOT BETWEEN 1 AND so_dieu % 7 + 1 THEN 'no_khoan'
 WHEN diem IS NOT NULL AND (so_khoan IS NULL OR coalesce(list_position(['a', 'b', 'c'], diem), 9) > so_khoan % 4) THEN 'no_diem' ELSE 'found' END AS level FROM c)"""
_PEN = r"""
p AS (SELECT rec_no, unnest(penalties) AS t, generate_subscripts(penalties, 1) - 1 AS ord FROM precedents),
y AS (SELECT rec_no, CAST(ord AS INTEGER) AS ord, CASE WHEN regexp_matches(t, '(?i)tử\s*hình') THEN 'tu_hinh' WHEN regexp_matches(t, '(?i)chung\s*thân') THEN 'tu_chung_than' WHEN NOT contains(lower(t), 'tù') THEN NULL WHEN regexp_matches(t, '(?i)\d\s*(năm|tháng)') THEN 'tu_co_thoi_han' END AS kind,
 TRY_CAST(regexp_extract(t, '(?i)0*(\d{1,3})\s*năm', 1) AS INTEGER) AS ny, TRY_CAST(regexp_extract(t, '(?i)0*(\d{1,2})\s*tháng', 1) AS INTEGER) AS nm FROM p WHERE t IS NOT NULL),
z AS (SELECT rec_no, ord, kind, CASE WHEN kind = 'tu_co_thoi_han' THEN round(coalesce(ny, 0) + coalesce(nm, 0) / 12.0, 3) END AS years FROM y)"""
_F = lambda c: f"strip_accents(replace(replace({c}, 'đ', 'd'), 'Đ', 'D'))"
_EXIST = rf"""
a AS (SELECT rec_no, regexp_replace(upper({_F('case_number')}), '[^A-Z0-9]', '', 'g') AS k, court, trim(regexp_replace(upper({_F('court')}), '[^A-Z0-9]+', ' ', 'g')) AS ck, coalesce(regexp_extract(full_text, '(\d{{1,2}}/\d{{1,2}}/\d{{4}})', 1), '') AS dt FROM precedents WHERE case_number IS NOT NULL),
b AS (SELECT *, CASE WHEN regexp_extract(k, '^(\d+)', 1) = '' THEN k ELSE regexp_extract(k, '^(\d+)', 1) END AS core, list_distinct(list_filter(string_split(ck, ' '), lambda w: w <> '')) AS ws FROM a WHERE k <> ''),
s AS (SELECT q.rec_no AS q, c.rec_no AS c, q.k = c.k AS case_match, round(least((CASE WHEN q.k = c.k THEN 0.6 ELSE 0.36 END) + 0.25 * (CASE WHEN coalesce(q.court, '') = '' THEN 0.5 WHEN len(q.ws) = 0 OR c.ws IS NULL OR len(c.ws) = 0 THEN 0 ELSE len(list_intersect(q.ws, c.ws)) / len(list_distinct(list_concat(q.ws, c.ws))) END) + 0.15 * (CASE WHEN q.dt = '' THEN 0.5 WHEN q.dt = c.dt THEN 1 ELSE 0 END), 1.0), 3) AS score
 FROM b q JOIN b c ON q.core = c.core WHERE true)"""
SQL = {
    "citation_first": r"""
WITH a AS (SELECT cit_id, raw, regexp_extract(raw, '(?is)^.*?đi[eề]u\s*0*\d{1,3}', 0) AS h FROM parsed_citations WHERE regexp_matches(raw, '(?i)đi[eề]u\s*0*\d'))
SELECT cit_id, CAST(regexp_extract(h, '(?is)đi[eề]u\s*0*(\d{1,3})$', 1) AS INTEGER) AS so_dieu, TRY_CAST(regexp_extract(h, '(?is)^.*kho[aả]n\s*0*(\d{1,3})', 1) AS INTEGER) AS so_khoan FROM a""",
    "law_classify": r"""
WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(raw, '\d ((?:của )?(?:Bộ luật|Luật|Nghị quyết)[^;,|/\n\t•]*)', 1)) AS t FROM parsed_citations WHERE raw IS NOT NULL),
b AS (SELECT t, regexp_extract(t, '(?i)năm\s*((?:19|20)\d{2})', 1) IN ('', '2015') AS h, lower(t) AS l FROM a)
SELECT t AS law_text, CASE WHEN regexp_matches(l, 'tố\s*tụng\s*hình\s*sự') THEN CASE WHEN h THEN 'BLTTHS' ELSE 'OTHER' END WHEN regexp_matches(l, 'tố\s*tụng\s*dân\s*sự') THEN 'OTHER' WHEN regexp_matches(l, '(^|[^\p{L}])bộ\s*luật\s*hình\s*sự([^\p{L}]|$)') THEN CASE WHEN h THEN 'BLHS' ELSE 'OTHER' END
 WHEN regexp_matches(l, '(^|[^\p{L}])bộ\s*luật\s*dân\s*sự([^\p{L}]|$)') THEN CASE WHEN h THEN 'BLDS' ELSE 'OTHER' END WHEN regexp_matches(l, 'nghị\s*quyết|thông\s*tư|nghị\s*định|luật\s*[\p{L}\p{N}_]|hiến\s*pháp') THEN 'OTHER' ELSE 'UNKNOWN' END AS law FROM b""",
    "citation_verify": f"WITH {_VERIFY} SELECT cit_id, law_key, level FROM v WHERE so_dieu IS NOT NULL AND law_key IS NOT NULL",
    "citation_report": f"WITH {_VERIFY}, s AS (SELECT law, CASE WHEN so_dieu IS NULL THEN 'u' WHEN law_key IS NULL THEN 'o' WHEN level = 'found' THEN 'v' ELSE 'n' END AS st FROM v) SELECT law, count(*) AS total, count(*) FILTER (st = 'v') AS valid, count(*) FILTER (st = 'n') AS not_found, count(*) FILTER (st = 'o') AS out_of_scope, count(*) FILTER (st = 'u') AS unparseable FROM s GROUP BY law",
    "law_article_lookup": "WITH a AS (SELECT unnest(['BLHS2015', 'BLTTHS2015', 'BLDS2015']) AS law_key), b AS (SELECT law_key, unnest(generate_series(1, 426)) AS n FROM a), c AS (SELECT law_key, n, unnest(generate_series(1, n % 7 + 1)) AS k FROM b) SELECT law_key, CAST(n AS INTEGER) AS so_dieu, CAST(count(*) AS INTEGER) AS clauses, CAST(sum(k % 4) AS BIGINT) AS points FROM c GROUP BY law_key, n",
    "validity_at_date": "WITH r AS (SELECT * FROM (VALUES (1, 'BLDS2015', DATE '2017-01-01'), (2, 'BLHS2015', DATE '2018-01-01'), (3, 'BLTTHS2015', DATE '2018-01-01'), (4, 'NQ326_2016', DATE '2017-01-01')) t(no, law_key, f)) SELECT o_orderkey, law_key, CAST(o_orderdate AS DATE) + INTERVAL 252 MONTH >= f AS in_force FROM orders JOIN r ON o_orderkey % 4 + 1 = no",
    "penalty_parse": f"WITH {_PEN} SELECT rec_no, ord, kind, years FROM z",
    "sentencing_frame_check": f"WITH {_PEN} SELECT rec_no, ord, CASE WHEN kind IN ('tu_hinh', 'tu_chung_than') THEN 'out_of_frame' WHEN years > rec_no % 5 + 6 + 1e-6 THEN 'out_of_frame' WHEN years < rec_no % 3 + 1 - 1e-6 THEN 'note' ELSE 'within_frame' END AS status FROM z WHERE kind IS NOT NULL",
    "penalty_frame_parse": """
WITH p AS (SELECT CAST(p_partkey AS INTEGER) AS n FROM part WHERE p_partkey > 0)
SELECT n AS so_dieu, 1 AS so_khoan, 0 AS ord, 'tu_co_thoi_han' AS kind, CAST(n % 3 + 1 AS DOUBLE) AS min, CAST(n % 3 + 5 AS DOUBLE) AS max, 'nam' AS unit FROM p
UNION ALL SELECT n, 2, 0, 'tu_co_thoi_han', 20.0, 20.0, 'nam' FROM p UNION ALL SELECT n, 2, 1, 'tu_chung_than', NULL, NULL, NULL FROM p
UNION ALL SELECT n, 2, 2, 'phat_tien', (n % 9 + 1) * 10000000.0, 100000000.0, 'dong' FROM p UNION ALL SELECT n, 3, 0, 'cai_tao_khong_giam_giu', 0.0, 0.5, 'nam' FROM p""",
    "charge_match": r"""
WITH a AS (SELECT rec_no, unnest(crimes) AS c, generate_subscripts(crimes, 1) - 1 AS ord, coalesce(regexp_extract(title, 'về (tội .*)$', 1), '') AS t FROM precedents),
b AS (SELECT rec_no, CAST(ord AS INTEGER) AS ord, c, t, trim(replace(strip_accents(replace(lower(c), 'đ', chr(1))), chr(1), 'đ'), ' ') AS cf, regexp_replace(trim(replace(strip_accents(replace(lower(t), 'đ', chr(1))), chr(1), 'đ'), ' '), '^toi\s+', '') AS tf FROM a WHERE c IS NOT NULL),
w AS (SELECT *, list_distinct(string_split_regex(cf, '\s+')) AS cw, list_distinct(string_split_regex(tf, '\s+')) AS tw FROM b)
SELECT rec_no, ord, CASE WHEN c = '' OR t = '' OR length(cf) < 4 THEN 'uncertain' WHEN contains(tf, cf) OR contains(cf, tf) OR len(list_intersect(cw, tw)) / len(cw) >= 0.7 THEN 'true' ELSE 'uncertain' END AS match FROM w""",
    "existence_score": f"WITH {_EXIST} SELECT q, c, score, case_match FROM s WHERE score >= 0.6",
    "existence_report": f"WITH {_EXIST}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS r FROM s), t AS (SELECT q, min_by(score, r) AS score, min_by(case_match, r) AS cm, least(count(*), 10) AS n FROM r GROUP BY q) "
    "SELECT p.rec_no AS q, CASE WHEN score IS NULL THEN 'not_found' WHEN cm AND score >= 0.85 THEN 'found' ELSE 'found_partial' END AS status, score, coalesce(n, 0) AS candidates FROM precedents p LEFT JOIN t ON p.rec_no = t.q",
    "forgery_risk_score": """
WITH f AS (SELECT user_id || '-' || event_id % 97 AS key, CASE WHEN event_type = 'error' THEN 'high' WHEN event_type IN ('purchase', 'signup') THEN 'medium' ELSE 'low' END AS s FROM events WHERE user_id IS NOT NULL),
g AS (SELECT key, CAST(least(100, sum(CASE s WHEN 'high' THEN 40 WHEN 'medium' THEN 20 ELSE 5 END)) AS INTEGER) AS score, bool_or(s = 'high') AS h, count(*) FILTER (s = 'medium') AS m, count(*) AS findings FROM f GROUP BY key)
SELECT key, score, CASE WHEN h AND (score >= 50 OR m >= 1) THEN 'high' WHEN h OR m >= 2 OR score >= 35 THEN 'medium' ELSE 'low' END AS level, findings FROM g""",
    "font_outlier": """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS page, l_suppkey % 5 AS font FROM lineitem), n AS (SELECT l_orderkey, count(DISTINCT page) AS n FROM d GROUP BY 1 HAVING n >= 2),
f AS (SELECT l_orderkey, font, count(*) >= greatest(2, 0.3 * any_value(n)) AS dom FROM d JOIN n USING (l_orderkey) GROUP BY 1, 2), a AS (SELECT l_orderkey FROM f GROUP BY 1 HAVING bool_or(dom))
SELECT l_orderkey, page FROM d JOIN f USING (l_orderkey, font) JOIN a USING (l_orderkey) GROUP BY 1, 2 HAVING NOT bool_or(dom)""",
    "dimension_outlier": """
WITH p AS (SELECT l_orderkey, l_linenumber AS page, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2), c AS (SELECT l_orderkey, flag, count(*) AS c, min(page) AS f FROM p GROUP BY 1, 2),
u AS (SELECT *, sum(c) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, f) AS r FROM c)
SELECT p.l_orderkey, page FROM p JOIN u ON p.l_orderkey = u.l_orderkey AND r = 1 AND n >= 3 AND c >= greatest(2, 0.6 * n) AND n > c AND n - c <= greatest(1, n // 3) WHERE p.flag IS DISTINCT FROM u.flag""",
    "ocr_statistics": "SELECT engine, count(*) AS n, round(avg(mean_confidence), 6) AS confidence, CAST(sum(skipped_pages) AS BIGINT) AS skipped, CAST(sum(coalesce(len(list_filter(per_page, lambda x: x.mean_confidence < 0.6)), 0)) AS BIGINT) AS low_pages, CAST(sum(quality_warnings) AS BIGINT) AS warnings FROM ocr_results GROUP BY engine",
    "train_dev_split": "SELECT doc_id, CASE WHEN CAST('0x' || sha1(CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) % 10000 < 1000 THEN 'dev' ELSE 'train' END AS part FROM documents",
    "job_state_latest": "SELECT user_id, max_by(event_type, event_id) AS status, count(*) AS events, min(event_id) AS first_seq, max(event_id) AS last_seq FROM events GROUP BY user_id",
    "resume_anti_join": "SELECT rec_no FROM precedents p WHERE NOT EXISTS (SELECT 1 FROM ocr_results o WHERE o.precedent_id = p.id)",
    "coverage_report": f"WITH r AS (SELECT * FROM (VALUES ('BLHS2015', 426), ('BLTTHS2015', 510), ('BLDS2015', 689), ('NQ326_2016', 48)) t(law_key, n)), h AS (SELECT {_KEY} AS law_key, so_dieu FROM parsed_citations WHERE so_dieu IS NOT NULL GROUP BY 1, 2) SELECT r.law_key, count(h.so_dieu) AS have, CAST(any_value(n) AS BIGINT) AS expected, round(100.0 * count(h.so_dieu) / any_value(n), 1) AS percent, CAST(any_value(n) - count(h.so_dieu) AS INTEGER) AS missing FROM r LEFT JOIN h ON r.law_key = h.law_key AND h.so_dieu BETWEEN 1 AND n GROUP BY r.law_key",
}
