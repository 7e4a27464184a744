"""SQL of the default labeller. Its patterns look around; here each is walked along the text by a recursive table that
matches what stands behind as well and goes on from the span's own end."""

from __future__ import annotations

from lexicrux.functions import spans as S
from lexicrux.plans.proofs import _MONEY
from lexicrux.plans.spans import _DOCS, _SCAN, PLAIN

_W = r"[^\p{L}\p{N}_]"
_UP = f"[{S.UPPER}][{S.UPPER}0-9.]+"
_CAPS = rf"T[OÒ][AÀ]\s+ÁN\s+(?:NHÂN\s+DÂN|QUÂN\s+SỰ)(?:(?:,\s*|\s+){_UP})*"
#: name: (label, lead, inner, what stands behind, when a match is none)
_WALKS = {
    "legal": ("LEGAL_BASIS", "", r"(?:Căn\s+cứ(?:\s+vào)?|Áp\s+dụng)\s+[^.;]{0,80}?(?:[Đđ]iều\s+\d|Bộ\s+[Ll]uật|Luật\s|Nghị\s+quyết|Nghị\s+định|Pháp\s+lệnh)[^.]{0,400}?", rf"(?:\.(?:\s|$)|[;,]\s*{S.STOP_VERB}|$)", r"regexp_matches(x, '^(?:Căn\s+cứ|Áp\s+dụng)\s+biện\s+pháp')"),
    "point": ("POINT", "", r"[Đđ]iểm\s+[a-zđ]", r"[^.\p{L}\p{N}_][^.]{0,39}?(?:[Kk]hoản|[Đđ]iều)", "false"),
    "crime": ("CRIME", r"(?:về|phạm)\s+(?:vào\s+)?tội\s*:?\s+", rf'(?:{S.CAP}|{S.CRIME_HEAD})[^.;,:“”"()]{{0,90}}?', rf'(?:\s+(?:quy\s+định|theo)(?:{_W}|$)|\s*[.;,:“”"()])', "false"),
    "act": ("VIOLATION_ACT", r"(?:có|đã\s+(?:thực\s+hiện|có)|thực\s+hiện)\s+hành\s+vi\s+", r"[^.;,]{9,149}?[^.;,\d]", r"[.;,](?:\D|$)", rf"regexp_matches(x, '^phạm\s+tội\s+quả\s+tang(?:{_W}|$)')"),
    "court": ("COURT", "", _CAPS, "", "false"),
}
_CUT = rf"coalesce(nullif(regexp_extract(i, '^(.*?)(?:,\s*|\s+)(?:(?:CỘNG|NƯỚC|NHẬN|XÉT|QUYẾT|ĐỘC|THẨM|TM|HỘI)(?:{_W}|$)|NHÂN\s+DANH)', 1), ''), i)"


def _walk(name: str, table: str = "t") -> str:
    label, lead, inner, behind, none = _WALKS[name]
    last = rf"|({lead})([^.;,]{{10,150}}?)$" if name == "act" else ""
    own = f"(?s:^(.*?))(?:({lead})({inner}){behind}{last})"
    names = "['b', 'l', 'i'" + (", 'l2', 'i2'" if last else "") + "]"
    i, at = ("CASE WHEN g.i <> '' THEN g.i ELSE g.i2 END", "length(g.l) + length(g.l2)") if last else ("g.i", "length(g.l)")
    cut = _CUT if name == "court" else "i"
    return rf"""{name} AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS s, '' AS x FROM {table}
 UNION ALL SELECT doc_id, text, CASE WHEN {none} THEN b + 1 ELSE b + l + length(x) END, CASE WHEN {none} THEN -1 ELSE b + l END, x FROM (SELECT *, {cut} AS x FROM (SELECT doc_id, text, pos + length(g.b) AS b, {at} AS l, {i} AS i FROM (SELECT *, regexp_extract(substr(text, pos + 1), '{own}', {names}) AS g FROM (SELECT doc_id, text, pos FROM {name} WHERE regexp_matches(substr(text, pos + 1), '{own}'))))))"""


def _inner(label: str, rx: str, group: int) -> str:
    return (
        f"SELECT '{label}' AS label, doc_id, p AS x, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - CASE WHEN ends_with(m, p) THEN 0 ELSE 1 END - length(p) AS s FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{rx}')) AS m, unnest(regexp_extract_all(text, '{rx}', {group})) AS p, "
        f"unnest(list_slice(string_split_regex(text, '{rx}'), 1, len(regexp_extract_all(text, '{rx}')))) AS g, generate_subscripts(regexp_extract_all(text, '{rx}'), 1) AS i FROM t)"
    )


_NAMES = ("DEFENDANT", "PLAINTIFF", "VICTIM", "RELATED_PARTY")
_NONE = ", ".join(f"'{w}'" for w in S.NOT_NAMES)
_ARTICLES = [p for p in S.PATTERNS if p[0] in ("ARTICLE", "CLAUSE")]
_PLAIN_ROWS = "plain AS (" + " UNION ALL ".join(f"SELECT * FROM ({_inner(*p)})" + (f" WHERE regexp_extract(x, '^\\S+', 0) NOT IN ({_NONE})" if p[0] in _NAMES else "") for p in [*PLAIN, *_ARTICLES]) + ")"
_DATE = lambda rx, kind: f"SELECT '{kind}' AS kind, * FROM ({_SCAN('t', 'doc_id', 'text', rx)})"
_DATE_ROWS = (
    f"d1 AS ({_DATE(S.DATE_NUMERIC, 'n')} UNION ALL {_DATE(S.DATE_VERBOSE, 'v')}), d2 AS (SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS INTEGER) AS e FROM d1), d3 AS (SELECT d2.*, e - length(m) AS s, text FROM d2 JOIN t USING (doc_id)), "
    + "d4 AS (SELECT *, " + ", ".join(f"substr(text, greatest(s - {n}, 0) + 1, least(s, {n})) AS w{n}" for n in (30, 40, 120, 160)) + ", substr(text, e + 1, 160) AS after FROM d3), "
    + rf"dates AS (SELECT doc_id, m AS x, s FROM d4 WHERE CASE WHEN kind = 'n' THEN regexp_matches(w120, '{S.HEADER}') ELSE NOT regexp_matches(w30, '\d+/\d{{4}}/[\p{{L}}\p{{M}}\p{{N}}_-]+\s*$') AND (regexp_matches(after, 'xét\s+xử|tuyên\s+án') OR regexp_matches(w160, '{S.HEADER}') OR regexp_matches(w40, '[Tt]uyên\s+án\s*:?\s*$')) END)"
)
_MONEY_ROWS = rf"""
m1 AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '{_MONEY}')) AS m, unnest(list_slice(string_split_regex(text, '{_MONEY}'), 1, len(regexp_extract_all(text, '{_MONEY}')))) AS g, generate_subscripts(regexp_extract_all(text, '{_MONEY}'), 1) AS i FROM t),
m2 AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e, length(regexp_extract(m, '^[^\d]', 0)) AS pre, CASE WHEN regexp_matches(m, '(đồng|đ)$') THEN 0 ELSE 1 END AS post FROM m1),
m3 AS (SELECT doc_id, m[pre + 1 : length(m) - post] AS x, e - length(m) + pre AS s, lower(substr(text, CAST(greatest(e - length(m) + pre - 60, 0) AS INTEGER) + 1, CAST(least(e - length(m) + pre, 60) AS INTEGER)) || ' | ' || substr(text, CAST(e - post AS INTEGER) + 1, 40)) AS near FROM m2),
money AS (SELECT doc_id, x, s, CASE WHEN contains(near, 'án phí') OR contains(near, 'lệ phí') THEN 'COURT_FEE' WHEN contains(near, 'bồi thường') THEN 'COMPENSATION' ELSE 'MONEY_AMOUNT' END AS label FROM m3)"""
_RULED = r"(?:Tuyên\s+bố|Tuyên\s+xử|Xử\s+phạt|Buộc|Áp\s+dụng\s+biện\s+pháp)[^\p{L}\p{N}_\n].{4,399}?"
_RULED_RX = f"(?s:^(.*?))({_RULED})(?:[.;](?:\\s|$)|$)"

#: Tables up to `entities` (doc_id, ord, s, e, label, x); they need WITH RECURSIVE.
ENTITIES = f"""
{_DOCS}, {', '.join(_walk(n) for n in _WALKS)}, {_PLAIN_ROWS}, {_DATE_ROWS}, {_MONEY_ROWS},
spans AS (SELECT doc_id, label, CAST(s AS BIGINT) AS s, CAST(s + length(x) AS BIGINT) AS e, x FROM ({' UNION ALL '.join(f"SELECT doc_id, '{w[0]}' AS label, s, x FROM {n} WHERE s >= 0" for n, w in _WALKS.items())} UNION ALL SELECT doc_id, label, s, x FROM plain UNION ALL SELECT doc_id, 'JUDGMENT_DATE', s, x FROM dates UNION ALL SELECT doc_id, label, s, x FROM money)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE label {' '.join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(S.RANKS))} ELSE 99 END, s - e, s, e, label, x) AS no FROM spans),
chosen AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS no, CAST([] AS STRUCT(s BIGINT, e BIGINT, n BIGINT)[]) AS kept FROM spans
 UNION ALL SELECT c.doc_id, r.no, CASE WHEN len(list_filter(kept, lambda k: r.s < k.e AND k.s < r.e)) > 0 THEN kept ELSE list_append(kept, {{'s': r.s, 'e': r.e, 'n': r.no}}) END FROM chosen c JOIN ranked r ON r.doc_id = c.doc_id AND r.no = c.no + 1),
taken AS (SELECT doc_id, unnest(max_by(kept, no)) AS k FROM chosen GROUP BY doc_id), kept AS (SELECT r.doc_id, r.label, r.s, r.e, r.x FROM taken JOIN ranked r ON r.doc_id = taken.doc_id AND r.no = taken.k.n),
zone AS (SELECT doc_id, text, CAST(length(regexp_extract(text, '(?s)^.*QUYẾT\\s+ĐỊNH\\s*:?', 0)) AS BIGINT) AS z FROM t WHERE regexp_matches(text, 'QUYẾT\\s+ĐỊNH')),
ruled AS (SELECT doc_id, text, z AS pos, CAST(-1 AS BIGINT) AS s, CAST(-1 AS BIGINT) AS e FROM zone
 UNION ALL SELECT doc_id, text, pos + length(g.b) + length(g.i), pos + length(g.b), pos + length(g.b) + length(g.i) FROM (SELECT *, regexp_extract(substr(text, pos + 1), '{_RULED_RX}', ['b', 'i']) AS g FROM (SELECT doc_id, text, pos FROM ruled WHERE regexp_matches(substr(text, pos + 1), '{_RULED_RX}')))),
cover AS (SELECT r.doc_id, r.s AS a, r.e AS b, k.s, k.e FROM ruled r JOIN kept k ON k.doc_id = r.doc_id AND k.s < r.e AND k.e > r.s WHERE r.s >= 0 UNION ALL SELECT doc_id, s, e, e, e FROM ruled WHERE s >= 0),
edge AS (SELECT *, greatest(a, coalesce(max(e) OVER (PARTITION BY doc_id, a, b ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS done FROM cover),
gap AS (SELECT edge.doc_id, done, substr(text, done + 1, least(s, b) - done) AS seg FROM edge JOIN t USING (doc_id) WHERE least(s, b) > done),
rest AS (SELECT doc_id, done + length(regexp_extract(seg, '^([^\\p{{L}}\\p{{N}}_]*)', 1)) AS s, regexp_extract(seg, '(?s)[\\p{{L}}\\p{{N}}_](?:.*[\\p{{L}}\\p{{N}}_])?', 0) AS x FROM gap),
every AS (SELECT doc_id, label, s, e, x FROM kept UNION ALL SELECT doc_id, 'DECISION', s, s + length(x), x FROM rest WHERE length(x) >= 2),
entities AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, label, x) - 1 AS ord FROM every)"""
SQL = {
    "entity_spans": f'WITH RECURSIVE {ENTITIES} SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", label, x AS text FROM entities',
    "label_counts": f"WITH RECURSIVE {ENTITIES} SELECT label, count(*) AS spans, count(DISTINCT doc_id) AS docs FROM entities GROUP BY label",
}

_KEY = lambda c: rf"lower(trim(regexp_replace(regexp_replace(trim({c}), '\s*(?:năm\s+)?(?:19|20)\d{{2}}.*$', ''), '\s+', ' ', 'g'), ' ,;.'))"
_LAWS = r"Bộ\s*luật|Luật|Nghị\s*định|Thông\s*tư|Nghị\s*quyết|Pháp\s*lệnh|Hiến\s*pháp"
_PAIR = rf"(?i)Điều\s+(\d+)[^;.\n]{{0,80}}?((?:{_LAWS})[^;,.\n(]{{0,70}})"
_COUNTED = """
c AS (SELECT coalesce(g.label, p.label) AS label, coalesce(hit.tp, 0) AS tp, coalesce(g.n, 0) AS gold, coalesce(p.n, 0) AS pred FROM (SELECT label, count(*) AS n FROM go GROUP BY label) g FULL JOIN (SELECT label, count(*) AS n FROM pr GROUP BY label) p ON g.label = p.label LEFT JOIN hit ON hit.label = coalesce(g.label, p.label)),
v AS (SELECT * FROM c UNION ALL SELECT 'micro', sum(tp), sum(gold), sum(pred) FROM c), w AS (SELECT *, CASE WHEN pred = 0 THEN 0.0 ELSE tp / pred END AS p, CASE WHEN gold = 0 THEN 0.0 ELSE tp / gold END AS r FROM v)
SELECT label, CAST(tp AS BIGINT) AS tp, CAST(gold AS BIGINT) AS gold, CAST(pred AS BIGINT) AS pred, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM w"""
_BOTH = """sp AS (SELECT id AS doc_id, unnest(spans) AS s, generate_subscripts(spans, 1) - 1 AS ord FROM gold_spans),
go AS (SELECT doc_id, ord, s.label AS label, CAST(s.start AS BIGINT) AS s, CAST(s."end" AS BIGINT) AS e FROM sp WHERE doc_id IN (SELECT doc_id FROM t)), pr AS (SELECT doc_id, ord, label, s, e FROM entities WHERE doc_id IN (SELECT id FROM gold_spans))"""
_FIRSTS = "ft AS (SELECT doc_id, label, trim(x, ' ') AS tx, min(s) AS p FROM entities WHERE trim(x, ' ') <> '' GROUP BY ALL), fr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY p) AS r FROM ft)"
_PAIRS = rf"""
pb AS (SELECT doc_id, CASE label WHEN 'LEGAL_BASIS' THEN 0 ELSE 1 END AS o1, s AS o2, x FROM entities WHERE label IN ('LEGAL_BASIS', 'ARTICLE')),
pm AS (SELECT doc_id, 0 AS o0, o1, o2, unnest(regexp_extract_all(x, '{_PAIR}')) AS m, generate_subscripts(regexp_extract_all(x, '{_PAIR}'), 1) AS o3 FROM pb),
named AS (SELECT doc_id, o0, o1, o2, o3, CAST(regexp_extract(m, '{_PAIR}', 1) AS INTEGER) AS article, trim(regexp_extract(m, '{_PAIR}', 2), ' ,;.') AS law FROM pm),
dl AS (SELECT doc_id, min_by(trim(x, ' '), s) AS law FROM entities WHERE label = 'LAW_NAME' AND trim(x, ' ') <> '' GROUP BY doc_id),
bx AS (SELECT doc_id, 1 AS o0, o1, o2, unnest(regexp_extract_all(x, 'Điều\s+(\d+)', 1)) AS a, generate_subscripts(regexp_extract_all(x, 'Điều\s+(\d+)', 1), 1) AS o3 FROM pb),
bare AS (SELECT bx.doc_id, o0, o1, o2, o3, CAST(a AS INTEGER) AS article, dl.law FROM bx JOIN dl USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.doc_id = bx.doc_id AND n.article = CAST(bx.a AS INTEGER))),
pa AS (SELECT *, {_KEY('law')} AS key FROM (SELECT * FROM named UNION ALL SELECT * FROM bare)), po AS (SELECT *, row_number() OVER (PARTITION BY doc_id, article, key ORDER BY o0, o1, o2, o3) AS r FROM pa),
pn AS (SELECT doc_id, article, law, key, row_number() OVER (PARTITION BY doc_id ORDER BY o0, o1, o2, o3) AS ord FROM po WHERE r = 1), pairs AS (SELECT * FROM pn WHERE ord <= 8)"""
_TAGGED = r"""CASE WHEN coalesce(l, '') = '' THEN 'UNKNOWN' WHEN regexp_matches(l, 'tố\s*tụng\s*hình\s*sự') THEN CASE WHEN held THEN 'BLTTHS' ELSE 'OTHER' END WHEN regexp_matches(l, 'tố\s*tụng\s*dân\s*sự') THEN 'OTHER'
 WHEN regexp_matches(l, '(^|[^\p{L}])bộ\s*luật\s*hình\s*sự([^\p{L}]|$)') THEN CASE WHEN held THEN 'BLHS' ELSE 'OTHER' END WHEN regexp_matches(l, '(^|[^\p{L}])bộ\s*luật\s*dân\s*sự([^\p{L}]|$)') THEN CASE WHEN held THEN 'BLDS' ELSE 'OTHER' END
 WHEN regexp_matches(l, 'nghị\s*quyết|thông\s*tư|nghị\s*định|luật\s*[\p{L}\p{N}_]|hiến\s*pháp') THEN 'OTHER' ELSE 'UNKNOWN' END"""
SQL |= {
    "span_prf": f"""
WITH RECURSIVE {ENTITIES}, {_BOTH}, gn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, s, e) AS r FROM go), pq AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, s, e) AS r FROM pr),
hit AS (SELECT label, count(*) AS tp FROM gn JOIN pq USING (doc_id, label, s, e, r) GROUP BY label), {_COUNTED}""",
    "span_prf_overlap": f"""
WITH RECURSIVE {ENTITIES}, {_BOTH}, gl AS (SELECT doc_id, label, list({{'s': s, 'e': e}} ORDER BY ord, s, e) AS gs FROM go GROUP BY ALL), pl AS (SELECT doc_id, label, list({{'s': s, 'e': e}} ORDER BY ord, s, e) AS ps FROM pr GROUP BY ALL),
ov AS (SELECT gl.doc_id, gl.label, gs, ps, 0 AS i, 0 AS tp FROM gl JOIN pl USING (doc_id, label)
 UNION ALL SELECT doc_id, label, gs, CASE WHEN f > 0 THEN list_filter(ps, lambda x, j: j <> f) ELSE ps END, i + 1, tp + CASE WHEN f > 0 THEN 1 ELSE 0 END FROM (SELECT *, coalesce(list_position(list_transform(ps, lambda x: x.s < gs[i + 1].e AND x.e > gs[i + 1].s), true), 0) AS f FROM ov WHERE i < len(gs))),
hit AS (SELECT label, sum(tp) AS tp FROM ov WHERE i = len(gs) GROUP BY label), {_COUNTED}""",
    "case_questions": rf"""
WITH RECURSIVE {ENTITIES}, {_FIRSTS}, g AS (SELECT doc_id, list(tx ORDER BY r) FILTER (label = 'PENALTY' AND r <= 12) AS pe, list(tx ORDER BY r) FILTER (label = 'LEGAL_BASIS' AND r <= 12) AS lb FROM fr GROUP BY doc_id),
b AS (SELECT doc_id, coalesce(list_filter(coalesce(pe, [])[1:5], lambda p: regexp_matches(p, '\d+\s*\([^)\d]+\)'))[1], pe[1], '(không rõ mức hình phạt)') AS penalty, coalesce(list_filter(coalesce(lb, [])[1:4], lambda b: contains(lower(b), 'hình sự') AND NOT contains(lower(b), 'tố tụng'))[1], lb[1], '') AS basis FROM g),
c AS (SELECT *, list_transform(regexp_extract_all(basis, '(?i)(?:điểm\s+[\p{{L}}\p{{N}}_]+\s+)?(?:khoản\s+\d+\s+)?Điều\s+\d+'), lambda x: regexp_replace(x, '\s+', ' ', 'g')) AS cs FROM b)
SELECT doc_id, penalty, basis, array_to_string(list_filter(cs, lambda x, i: list_position(cs, x) = i)[1:4], '; ') AS applied FROM c""",
    "citation_pairs": f"WITH RECURSIVE {ENTITIES}, {_PAIRS} SELECT doc_id, CAST(ord AS INTEGER) AS ord, article, law FROM pairs",
    "corpus_check": f"""
WITH RECURSIVE {ENTITIES}, {_PAIRS}, hits AS (SELECT DISTINCT so_dieu, lower('Văn bản hợp nhất ' || law_text) AS title FROM parsed_citations WHERE law_text IS NOT NULL AND so_dieu IS NOT NULL),
pw AS (SELECT *, list_filter(string_split(key, ' '), lambda x: x <> '' AND x NOT IN ('của', 'và', 'về', 'số', 'the')) AS ws FROM pairs)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, article, law, CASE WHEN EXISTS (SELECT 1 FROM hits WHERE so_dieu = article AND len(ws) > 0 AND len(list_filter(ws, lambda x: NOT contains(title, x))) = 0 AND contains(title, 'tố tụng') = contains(key, 'tố tụng')) THEN 'found' ELSE 'not_found' END AS status FROM pw""",
    "citation_spans": rf"""
WITH RECURSIVE {ENTITIES}, u AS (SELECT doc_id, label, x AS tx, s FROM entities WHERE label IN ('ARTICLE', 'CLAUSE', 'POINT', 'LAW_NAME')),
w AS (SELECT *, list({{'s': s, 'l': label, 't': tx}}) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS bef, list({{'s': s, 'l': label, 't': tx}}) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS aft FROM u),
a AS (SELECT doc_id, s, TRY_CAST(regexp_extract(tx, '(?i)đi[eề]u\s*0*(\d{{1,3}})', 1) AS INTEGER) AS so_dieu, list_filter(coalesce(bef, []), lambda x: w.s - x.s <= 60) AS near, list_filter(coalesce(aft, []), lambda x: x.s - w.s <= 60) AS ahead FROM w WHERE label = 'ARTICLE'),
b AS (SELECT doc_id, s, so_dieu, list_filter(near, lambda x: x.l = 'CLAUSE')[-1].t AS cm, list_filter(near, lambda x: x.l = 'POINT')[-1].t AS pm, coalesce(list_filter(near, lambda x: x.l = 'LAW_NAME')[-1].t, list_filter(ahead, lambda x: x.l = 'LAW_NAME')[1].t) AS law_text, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM a WHERE so_dieu IS NOT NULL),
c AS (SELECT *, lower(law_text) AS l, regexp_extract(law_text, '(?i)năm\s*((?:19|20)\d{{2}})', 1) IN ('', '2015') AS held FROM b),
d AS (SELECT doc_id, s, sum(CASE WHEN gap IS NULL OR gap > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS chain, so_dieu, TRY_CAST(regexp_extract(cm, '(?i)kho[aả]n\s*0*(\d{{1,3}})', 1) AS INTEGER) AS so_khoan, nullif(lower(regexp_extract(pm, '(?i)đi[eể]m\s+([a-zđ])', 1)), '') AS diem, {_TAGGED} AS law, law_text FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, so_dieu, so_khoan, diem, law ORDER BY chain, s) AS r FROM d)
SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(chain AS INTEGER) AS chain, so_dieu, so_khoan, diem, law, law_text FROM f WHERE r = 1""",
}


def _phrases(words: tuple[str, ...]) -> str:
    import re
    import unicodedata

    bare = ["".join(c for c in unicodedata.normalize("NFD", p.replace("đ", "d")) if not unicodedata.combining(c)) for p in words]
    return r"(?i)\b(?:" + "|".join(r"[\s,]+".join(map(re.escape, re.split(r"[\s,]+", p))) for p in sorted(bare, key=len, reverse=True)) + r")\b"


_FACTOR = lambda label, words: (
    f"SELECT '{label}' AS label, rec_no, sum(length(g) + length(m)) OVER (PARTITION BY rec_no ORDER BY i) - length(m) AS s, length(m) AS n FROM (SELECT rec_no, unnest(regexp_extract_all(ft, '{_phrases(words)}')) AS m, "
    f"unnest(list_slice(string_split_regex(ft, '{_phrases(words)}'), 1, len(regexp_extract_all(ft, '{_phrases(words)}')))) AS g, generate_subscripts(regexp_extract_all(ft, '{_phrases(words)}'), 1) AS i FROM f)"
)
SQL["factor_spans"] = (
    "WITH f AS (SELECT rec_no, full_text, strip_accents(replace(replace(full_text, 'đ', 'd'), 'Đ', 'D')) AS ft FROM precedents WHERE full_text IS NOT NULL), "
    + f"a AS ({_FACTOR('MITIGATING_FACTOR', S.MITIGATING)} UNION ALL {_FACTOR('AGGRAVATING_FACTOR', S.AGGRAVATING)}), b AS (SELECT a.*, substr(full_text, CAST(s AS INTEGER) + 1, n) AS x FROM a JOIN f USING (rec_no)) "
    + 'SELECT rec_no, CAST(row_number() OVER (PARTITION BY rec_no ORDER BY s, n, label) - 1 AS INTEGER) AS ord, label, CAST(s AS INTEGER) AS start, CAST(s + n AS INTEGER) AS "end", x AS text FROM b'
)
