"""Queries that put several checks together: citations out of spans, their counters, and the verdict on a judgment."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexicrux.functions import cases as C
from lexicrux.functions import spans as S
from lexicrux.functions import text as T
from lexicrux.operators import citations as K
from lexicrux.operators import forgery as G
from lexicrux.operators import law as L
from lexicrux.operators import verdict as V
from lexicrux.plans import legal, proofs
from lexicrux.plans.records import _FIRST, _SPANS, _gold
from lexicrux.plans.spans import _exploded


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


_PARTS = [p for p in S.PATTERNS if p[0] in ("ARTICLE", "CLAUSE", "LAW_NAME")]


def rebuilt_citations(spark, d):
    """Citations put together from separate articles, clauses and names of laws in the judgments."""
    every = F.concat(*(S.matches(F.col("full_text"), rx, label) for label, rx, _ in _PARTS))
    return K.reconstructed(_exploded(_t(spark, d, "precedents").select("rec_no", "full_text"), "rec_no", every), "rec_no")


def chained_citations(spark, d):
    """Citations of the annotated bases of judgments, a chain for each, every one once."""
    return K.collected(_gold(spark, d), "id").select("id", "chain", "so_dieu", "so_khoan", "diem", "law", "law_text")


def basis_pairs(spark, d):
    """Pairs of article and law in the annotated bases of judgments."""
    return C.pairs(_gold(spark, d), "id")


def basis_questions(spark, d):
    """What a question about a case takes from its annotated spans: penalty, offence basis, applied citations."""
    t = C.first_texts(_gold(spark, d), "id").groupBy("id").pivot("label", ["PENALTY", "LEGAL_BASIS"]).agg(F.first("texts"))
    none = F.array().cast("array<string>")
    basis = C.offence_basis(F.coalesce("LEGAL_BASIS", none))
    return t.select("id", C.pronounced_penalty(F.coalesce("PENALTY", none)).alias("penalty"), basis.alias("basis"), C.applied_citations(basis).alias("applied"))


def _checked(spark, d):
    """Every parsed citation with its level, whether the law was in force at the judgment's date, and how the judgment's most
    severe penalty and its first crime fit."""
    p = _t(spark, d, "precedents").where("id IS NOT NULL").withColumn("on", F.try_to_date(T.iso_date(F.regexp_extract("full_text", r"(\d{1,2}/\d{1,2}/\d{4})", 1)), "yyyy-MM-dd"))
    frame = F.array(F.struct(F.lit("tu_co_thoi_han").alias("kind"), F.lit(1.0).alias("min"), F.lit(7.0).alias("max"), F.lit("nam").alias("unit")))
    worst = L.severest(F.col("penalties"))
    one = p.groupBy("id").agg(*(F.min_by(c, "rec_no").alias(c) for c in ("on", "penalties", "crimes", "title")))
    one = one.select(F.col("id").alias("precedent_id"), "on", F.when(worst["kind"].isNotNull(), L.sentencing(worst["kind"], worst["years"], frame)).alias("penalty"), L.charge_match(F.try_element_at("crimes", F.lit(1)), F.regexp_extract("title", r"về (tội .*)$", 1)).alias("charge"))
    cits = legal._keyed(_t(spark, d, "parsed_citations").where("precedent_id IS NOT NULL").select("cit_id", "precedent_id", "so_dieu", "so_khoan", "diem", "law"))
    v = L.verify(cits, *legal._dims(spark))
    reg = F.broadcast(L.registry(spark).select("law_key", "effective_from", "effective_to"))  # four laws
    return v.join(one, "precedent_id", "left").join(reg, "law_key", "left").withColumn("in_force", L.in_force(F.col("on"), F.col("effective_from"), F.col("effective_to")))


def citation_counters(spark, d):
    """The whole report on the citations of each judgment, as counters."""
    return K.summary(_checked(spark, d), "precedent_id")


def overall_verification(spark, d):
    """All checks of every precedent: signs out of its recognised copies, its existence, its citations."""
    p = _t(spark, d, "precedents").select("rec_no", "id")
    o = _t(spark, d, "ocr_results").where("precedent_id IS NOT NULL")
    signs = F.array(F.when(F.col("quality_warnings") >= 3, F.struct(F.lit("ocr.warnings").alias("signal"), F.lit("medium").alias("severity"))), F.when(F.col("skipped_pages") > 0, F.struct(F.lit("ocr.skipped").alias("signal"), F.lit("low").alias("severity"))))
    findings = o.select(F.col("precedent_id").alias("id"), F.explode(F.array_compact(signs)).alias("f")).select("id", "f.*")
    t = p.join(G.risk(findings, "id"), "id").select("rec_no", "level", "score")
    e = legal.existence_report(spark, d).withColumnRenamed("q", "rec_no")
    c = p.join(K.summary(legal.L.verify(legal._keyed(_t(spark, d, "parsed_citations")), *legal._dims(spark)).where("precedent_id IS NOT NULL"), "precedent_id").withColumnRenamed("precedent_id", "id"), "id")
    x = V.overall(p, "rec_no", t, e, c)
    return x.withColumn("flags", F.array_join("flags", "|"))


QUERIES = {f.__name__: f for f in (rebuilt_citations, chained_citations, basis_pairs, basis_questions, citation_counters, overall_verification)}

_TAG = r"""CASE WHEN coalesce(l, '') = '' THEN 'UNKNOWN' WHEN regexp_matches(l, 'tố\s*tụng\s*hình\s*sự') THEN CASE WHEN held THEN 'BLTTHS' ELSE 'OTHER' END WHEN regexp_matches(l, 'tố\s*tụng\s*dân\s*sự') THEN 'OTHER'
 WHEN regexp_matches(l, '(^|[^\p{L}])bộ\s*luật\s*hình\s*sự([^\p{L}]|$)') THEN CASE WHEN held THEN 'BLHS' ELSE 'OTHER' END WHEN regexp_matches(l, '(^|[^\p{L}])bộ\s*luật\s*dân\s*sự([^\p{L}]|$)') THEN CASE WHEN held THEN 'BLDS' ELSE 'OTHER' END
 WHEN regexp_matches(l, 'nghị\s*quyết|thông\s*tư|nghị\s*định|luật\s*[\p{L}\p{N}_]|hiến\s*pháp') THEN 'OTHER' ELSE 'UNKNOWN' END"""
_ROWS = lambda label, rx: (
    f"SELECT '{label}' AS label, rec_no, m AS t, sum(length(g) + length(m)) OVER (PARTITION BY rec_no ORDER BY i) - length(m) AS s FROM (SELECT rec_no, unnest(regexp_extract_all(full_text, '{rx}')) AS m, "
    f"unnest(list_slice(string_split_regex(full_text, '{rx}'), 1, len(regexp_extract_all(full_text, '{rx}')))) AS g, generate_subscripts(regexp_extract_all(full_text, '{rx}'), 1) AS i FROM precedents)"
)
# the parser's tables over the annotated bases in place of parsed_citations
_BASES = proofs._PARSED.replace("parsed_citations", "bases")
_LEVELS = legal._VERIFY.replace("SELECT cit_id,", "SELECT cit_id, precedent_id,")
SQL = {
    "rebuilt_citations": "WITH u AS (" + " UNION ALL ".join(_ROWS(label, rx) for label, rx, _ in _PARTS) + r"""),
w AS (SELECT *, list({'s': s, 'l': label, 't': t}) OVER (PARTITION BY rec_no ORDER BY s ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS bef, list({'s': s, 'l': label, 't': t}) OVER (PARTITION BY rec_no ORDER BY s ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS aft FROM u),
a AS (SELECT rec_no, s, TRY_CAST(regexp_extract(t, '(?i)đi[eề]u\s*0*(\d{1,3})', 1) AS INTEGER) AS so_dieu, list_filter(coalesce(bef, []), lambda x: w.s - x.s <= 60) AS near, list_filter(coalesce(aft, []), lambda x: x.s - w.s <= 60) AS ahead FROM w WHERE label = 'ARTICLE'),
b AS (SELECT rec_no, s, so_dieu, list_filter(near, lambda x: x.l = 'CLAUSE')[-1].t AS cm, coalesce(list_filter(near, lambda x: x.l = 'LAW_NAME')[-1].t, list_filter(ahead, lambda x: x.l = 'LAW_NAME')[1].t) AS law_text, s - lag(s) OVER (PARTITION BY rec_no ORDER BY s) AS gap FROM a WHERE so_dieu IS NOT NULL),
c AS (SELECT *, lower(law_text) AS l, regexp_extract(law_text, '(?i)năm\s*((?:19|20)\d{2})', 1) IN ('', '2015') AS held FROM b)
""" + f"SELECT rec_no, CAST(s AS INTEGER) AS start, CAST(sum(CASE WHEN gap IS NULL OR gap > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_no ORDER BY s) AS INTEGER) AS chain, so_dieu, TRY_CAST(regexp_extract(cm, '(?i)kho[aả]n\\s*0*(\\d{{1,3}})', 1) AS INTEGER) AS so_khoan, CAST(NULL AS VARCHAR) AS diem, {_TAG} AS law, law_text FROM c",
    "chained_citations": f"""
WITH {_SPANS}, b0 AS (SELECT id, s.start AS st, s.text AS raw, row_number() OVER (PARTITION BY id ORDER BY s.start) - 1 AS chain FROM sp WHERE s.label = 'LEGAL_BASIS'), bases AS (SELECT row_number() OVER () AS cit_id, * FROM b0), {_BASES},
o AS (SELECT bases.id, chain, st, k.*, row_number() OVER (PARTITION BY bases.id, so_dieu, so_khoan, diem, law ORDER BY chain, st, k.ord) AS r FROM k JOIN bases USING (cit_id)) SELECT id, CAST(chain AS INTEGER) AS chain, so_dieu, so_khoan, diem, law, law_text FROM o WHERE r = 1""",
    "basis_pairs": rf"""
WITH {_SPANS}, b AS (SELECT id, s.start AS o2, regexp_extract_all(s.text, '(?i)Điều\s+(\d+)[^;.\n]{{0,80}}?((?:Bộ\s*luật|Luật|Nghị\s*định|Thông\s*tư|Nghị\s*quyết|Pháp\s*lệnh|Hiến\s*pháp)[^;,.\n(]{{0,70}})') AS ms FROM sp WHERE s.label = 'LEGAL_BASIS'),
m AS (SELECT id, o2, unnest(ms) AS m, generate_subscripts(ms, 1) AS o3 FROM b), n AS (SELECT id, o2, o3, CAST(regexp_extract(m, '(?i)Điều\s+(\d+)', 1) AS INTEGER) AS article, trim(regexp_extract(m, '(?i)Điều\s+\d+[^;.\n]{{0,80}}?((?:Bộ\s*luật|Luật|Nghị\s*định|Thông\s*tư|Nghị\s*quyết|Pháp\s*lệnh|Hiến\s*pháp)[^;,.\n(]{{0,70}})', 1), ' ,;.') AS law FROM m),
k AS (SELECT *, lower(trim(regexp_replace(regexp_replace(law, '\s*(?:năm\s+)?(?:19|20)\d{{2}}.*$', ''), '\s+', ' ', 'g'), ' ,;.')) AS key FROM n), f AS (SELECT *, row_number() OVER (PARTITION BY id, article, key ORDER BY o2, o3) AS r FROM k),
g AS (SELECT id, article, law, row_number() OVER (PARTITION BY id ORDER BY o2, o3) AS ord FROM f WHERE r = 1) SELECT id, CAST(ord AS INTEGER) AS ord, article, law FROM g WHERE ord <= 8""",
    "basis_questions": rf"""
WITH {_SPANS}, {_FIRST}, g AS (SELECT id, list(t ORDER BY r) FILTER (label = 'PENALTY' AND r <= 12) AS pe, list(t ORDER BY r) FILTER (label = 'LEGAL_BASIS' AND r <= 12) AS lb FROM fr GROUP BY id),
b AS (SELECT id, coalesce(list_filter(coalesce(pe, [])[1:5], lambda p: regexp_matches(p, '\d+\s*\([^)\d]+\)'))[1], pe[1], '(không rõ mức hình phạt)') AS penalty, coalesce(list_filter(coalesce(lb, [])[1:4], lambda b: contains(lower(b), 'hình sự') AND NOT contains(lower(b), 'tố tụng'))[1], lb[1], '') AS basis FROM g),
c AS (SELECT *, list_transform(regexp_extract_all(basis, '(?i)(?:điểm\s+[\p{{L}}\p{{N}}_]+\s+)?(?:khoản\s+\d+\s+)?Điều\s+\d+'), lambda x: regexp_replace(x, '\s+', ' ', 'g')) AS cs FROM b)
SELECT id, penalty, basis, array_to_string(list_filter(cs, lambda x, i: list_position(cs, x) = i)[1:4], '; ') AS applied FROM c""",
    "citation_counters": f"""
WITH {_LEVELS}, {legal._PEN}, q AS (SELECT *, row_number() OVER (PARTITION BY rec_no ORDER BY CASE kind WHEN 'tu_hinh' THEN 3 WHEN 'tu_chung_than' THEN 2 ELSE 1 END DESC, coalesce(years, 0) DESC, ord) AS r FROM z WHERE kind IS NOT NULL),
f AS (SELECT p.id, p.rec_no, crimes[1] AS cr, coalesce(regexp_extract(title, 'về (tội .*)$', 1), '') AS ti, regexp_extract(full_text, '(\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})', 1) AS dt, row_number() OVER (PARTITION BY p.id ORDER BY p.rec_no) AS nth FROM precedents p WHERE p.id IS NOT NULL),
n AS (SELECT f.id, TRY_CAST(try_strptime(dt, '%d/%m/%Y') AS DATE) AS d, CASE WHEN kind IN ('tu_hinh', 'tu_chung_than') THEN true WHEN years > 7 + 1e-6 THEN true ELSE false END AS oof,
 trim(replace(strip_accents(replace(lower(cr), 'đ', chr(1))), chr(1), 'đ'), ' ') AS cf, regexp_replace(trim(replace(strip_accents(replace(lower(ti), 'đ', chr(1))), chr(1), 'đ'), ' '), '^toi\\s+', '') AS tf, cr, ti FROM f LEFT JOIN q ON f.rec_no = q.rec_no AND q.r = 1 WHERE nth = 1),
o AS (SELECT *, coalesce(cr, '') <> '' AND ti <> '' AND length(cf) >= 4 AND (contains(tf, cf) OR contains(cf, tf) OR len(list_intersect(list_distinct(string_split_regex(cf, '\\s+')), list_distinct(string_split_regex(tf, '\\s+')))) / len(list_distinct(string_split_regex(cf, '\\s+'))) >= 0.7) AS charged FROM n),
j AS (SELECT v.*, o.d < CASE v.law_key WHEN 'BLDS2015' THEN DATE '2017-01-01' WHEN 'BLHS2015' THEN DATE '2018-01-01' WHEN 'BLTTHS2015' THEN DATE '2018-01-01' END AS early, o.oof, o.charged FROM v LEFT JOIN o ON v.precedent_id = o.id WHERE v.precedent_id IS NOT NULL)
SELECT precedent_id, count(*) AS total, count(*) FILTER (law_key IS NOT NULL AND level = 'found') AS valid, count(*) FILTER (law_key IS NOT NULL AND level <> 'found') AS not_found, count(*) FILTER (law_key IS NULL) AS out_of_scope, count(*) FILTER (law_key IS NOT NULL AND level = 'no_dieu') AS no_dieu,
 count(*) FILTER (law_key IS NOT NULL AND level = 'no_khoan') AS no_khoan, count(*) FILTER (law_key IS NOT NULL AND level = 'no_diem') AS no_diem, count(*) FILTER (law_key IS NOT NULL AND early) AS not_in_force, count(*) FILTER (oof) AS out_of_frame, count(*) FILTER (charged) AS charge_matched FROM j GROUP BY precedent_id""",
    "overall_verification": f"""
WITH {legal._EXIST}, rr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS r FROM s), tt AS (SELECT q, min_by(score, r) AS score, min_by(case_match, r) AS cm FROM rr GROUP BY q),
ex AS (SELECT p.rec_no, CASE WHEN score IS NULL THEN 'not_found' WHEN cm AND score >= 0.85 THEN 'found' ELSE 'found_partial' END AS existence FROM precedents p LEFT JOIN tt ON p.rec_no = tt.q),
fi AS (SELECT precedent_id AS id, 20 AS w, 1 AS m FROM ocr_results WHERE precedent_id IS NOT NULL AND quality_warnings >= 3 UNION ALL SELECT precedent_id, 5, 0 FROM ocr_results WHERE precedent_id IS NOT NULL AND skipped_pages > 0),
ta AS (SELECT id, CAST(least(100, sum(w)) AS INTEGER) AS score, CASE WHEN sum(m) >= 2 OR sum(w) >= 35 THEN 'medium' ELSE 'low' END AS level FROM fi GROUP BY id), {_LEVELS.replace('c AS', 'cc AS').replace('FROM c)', 'FROM cc)')},
ci AS (SELECT precedent_id, count(*) AS total, count(*) FILTER (law_key IS NOT NULL AND level = 'found') AS valid, count(*) FILTER (law_key IS NOT NULL AND level <> 'found') AS not_found, count(*) FILTER (law_key IS NULL) AS out_of_scope FROM v WHERE precedent_id IS NOT NULL GROUP BY precedent_id)
SELECT p.rec_no, coalesce(ta.level, 'skipped') AS tampering, ta.score AS tampering_score, existence, CASE WHEN total IS NULL THEN 'skipped' ELSE 'checked' END AS citations, total, valid, not_found, out_of_scope,
 array_to_string(list_filter([CASE WHEN ta.level = 'medium' THEN 'tampering' END, CASE existence WHEN 'found_partial' THEN 'existence_partial' WHEN 'not_found' THEN 'existence_not_found' END, CASE WHEN not_found > 0 THEN 'citations_not_found' END], lambda x: x IS NOT NULL), '|') AS flags
FROM precedents p JOIN ex ON ex.rec_no = p.rec_no LEFT JOIN ta ON ta.id = p.id LEFT JOIN ci ON ci.precedent_id = p.id""",
}
