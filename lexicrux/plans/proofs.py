"""SQL for queries that carry state along a text or an order: recursive tables in place of aggregates over arrays."""

from __future__ import annotations

from lexicrux.plans import search
from lexicrux.plans.spans import _DOCS, _TAG, _TOK

_SORTED = "regexp_replace(regexp_replace({c}, '([.!?;…])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g')"
_SENTENCES = lambda c: f"list_filter(list_transform(string_split({_SORTED.format(c=c)}, chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_SECTIONS = r"""
t AS (SELECT rec_no, full_text AS text FROM precedents WHERE full_text IS NOT NULL),
s1 AS (SELECT rec_no, text, CASE WHEN regexp_matches(text, 'NHÂN\s+DANH') THEN length(regexp_extract(text, '(?s)^(.*?)NHÂN\s+DANH', 1)) END AS p1 FROM t), s2 AS (SELECT *, coalesce(p1, 0) AS c1 FROM s1),
s3 AS (SELECT *, CASE WHEN regexp_matches(substr(text, c1 + 1), 'NỘI\s+DUNG\s+VỤ\s+ÁN') THEN c1 + length(regexp_extract(substr(text, c1 + 1), '(?s)^(.*?)NỘI\s+DUNG\s+VỤ\s+ÁN', 1)) END AS p2 FROM s2), s4 AS (SELECT *, coalesce(p2, c1) AS c2 FROM s3),
s5 AS (SELECT *, CASE WHEN regexp_matches(substr(text, c2 + 1), 'NHẬN\s+ĐỊNH') THEN c2 + length(regexp_extract(substr(text, c2 + 1), '(?s)^(.*?)NHẬN\s+ĐỊNH', 1)) END AS p3 FROM s4), s6 AS (SELECT *, coalesce(p3, c2) AS c3 FROM s5),
s7 AS (SELECT *, CASE WHEN regexp_matches(substr(text, c3 + 1), 'QUYẾT\s+ĐỊNH') THEN c3 + length(regexp_extract(substr(text, c3 + 1), '(?s)^(.*)QUYẾT\s+ĐỊNH', 1)) WHEN regexp_matches(text, 'QUYẾT\s+ĐỊNH') THEN length(regexp_extract(text, '(?s)^(.*)QUYẾT\s+ĐỊNH', 1)) END AS p4 FROM s6),
m AS (SELECT rec_no, 1 AS i, 'NHAN_DANH' AS name, p1 AS a FROM s7 WHERE p1 IS NOT NULL UNION ALL SELECT rec_no, 2, 'NOI_DUNG', p2 FROM s7 WHERE p2 IS NOT NULL UNION ALL SELECT rec_no, 3, 'NHAN_DINH', p3 FROM s7 WHERE p3 IS NOT NULL UNION ALL SELECT rec_no, 4, 'QUYET_DINH', p4 FROM s7 WHERE p4 IS NOT NULL UNION ALL SELECT rec_no, 0, 'PREAMBLE', 0 FROM s7 WHERE coalesce(p1, p2, p3, p4, 1) > 0),
e AS (SELECT m.rec_no, row_number() OVER w - 1 AS ord, name, a, coalesce(lead(a) OVER w, length(text)) AS b FROM m JOIN t ON m.rec_no = t.rec_no WINDOW w AS (PARTITION BY m.rec_no ORDER BY i))"""
_TAIL = r"CASE WHEN length(cur) <= 150 THEN cur WHEN regexp_matches(right(cur, 150), '[.!?;…]\s+') THEN regexp_replace(right(cur, 150), '(?s)^.*?[.!?;…]\s+', '') WHEN contains(right(cur, 150), ' ') THEN regexp_replace(right(cur, 150), '(?s)^[^ ]* ', '') ELSE right(cur, 150) END"
_PASSAGES = rf"""
st AS (SELECT rec_no, {_SENTENCES('full_text')} AS ss FROM precedents WHERE full_text IS NOT NULL),
w AS (SELECT rec_no, ss, 0 AS i, '' AS cur, CAST([] AS VARCHAR[]) AS emitted FROM st
 UNION ALL SELECT rec_no, ss, i + 1, CASE WHEN length(s) > 900 THEN '' WHEN cur <> '' AND length(cur) + 1 + length(s) > 900 THEN trim(tl || ' ' || s, ' ' || chr(9) || chr(10) || chr(13)) WHEN cur = '' THEN s ELSE cur || ' ' || s END,
  CASE WHEN length(s) > 900 THEN list_concat(CASE WHEN cur <> '' THEN [cur] ELSE [] END, list_transform(generate_series(0, length(s) - 1, 750), lambda k: substr(s, CAST(k AS INTEGER) + 1, 900))) WHEN cur <> '' AND length(cur) + 1 + length(s) > 900 THEN [cur] ELSE [] END
  FROM (SELECT *, ss[i + 1] AS s, {_TAIL} AS tl FROM w WHERE i < len(ss))),
o AS (SELECT rec_no, i, emitted FROM w UNION ALL SELECT rec_no, i + 1, [cur] FROM w WHERE i = len(ss) AND cur <> ''),
x AS (SELECT rec_no, i, unnest(emitted) AS text, generate_subscripts(emitted, 1) AS j FROM o), c AS (SELECT rec_no, CAST(row_number() OVER (PARTITION BY rec_no ORDER BY i, j) - 1 AS INTEGER) AS chunk, text FROM x)"""
_PART = lambda c, rx, i: f"regexp_extract({c}, '{rx}', {i})"
_MONEY = r"(?:^|[^\d./–\-])(?:\d{1,3}(?:[.,]\d{3})+|\d{4,9})(?:\s*\([^)]{1,80}\))?\s*(?:đồng|đ(?:[^\p{L}\p{N}_]|$))"

SQL = {
    "sectioning": f'WITH {_SECTIONS} SELECT rec_no, CAST(ord AS INTEGER) AS ord, name, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", b >= a AS is_wellformed FROM e',
    "chunk_judgments": f"WITH RECURSIVE {_PASSAGES} SELECT rec_no, chunk, text FROM c",
    "overlap_resolve": """
WITH RECURSIVE i AS (SELECT l_orderkey, CAST(l_partkey % 200 AS INTEGER) AS s, CAST(l_partkey % 200 + 5 + l_suppkey % 30 AS INTEGER) AS e, ['PENALTY', 'CRIME', 'LAW_NAME', 'ARTICLE'][l_linenumber % 4 + 1] AS label FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE label WHEN 'PENALTY' THEN 3 WHEN 'CRIME' THEN 4 WHEN 'LAW_NAME' THEN 5 ELSE 14 END, s - e, s, e, label) AS no FROM i),
w AS (SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT) AS no, CAST([] AS STRUCT(s INTEGER, e INTEGER)[]) AS kept FROM i
 UNION ALL SELECT w.l_orderkey, r.no, CASE WHEN len(list_filter(kept, lambda k: r.s < k.e AND k.s < r.e)) > 0 THEN kept ELSE list_append(kept, {'s': r.s, 'e': r.e}) END FROM w JOIN r ON r.l_orderkey = w.l_orderkey AND r.no = w.no + 1),
z AS (SELECT l_orderkey, max_by(kept, no) AS kept FROM w GROUP BY l_orderkey)
SELECT l_orderkey, CAST(len(kept) AS INTEGER) AS kept_spans, CAST(list_sum(list_transform(kept, lambda k: k.e - k.s)) AS INTEGER) AS covered FROM z""",
    "sentence_windows": r"""
WITH RECURSIVE a AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, len(t) AS n, list_filter(list_transform(t, lambda x, i: CASE WHEN x IN ('.', ';', ':', '?', '!') THEN i END), lambda x: x IS NOT NULL) AS ends FROM a WHERE len(t) > 0),
w AS (SELECT doc_id, n, ends, 0 AS ord, CAST(0 AS BIGINT) AS lo, CASE WHEN n <= 200 THEN n ELSE coalesce(list_min(list_filter(ends, lambda e: e >= least(200, n) AND e <= least(250, n))), least(250, n)) END AS hi FROM b
 UNION ALL SELECT doc_id, n, ends, ord + 1, nlo, coalesce(list_min(list_filter(ends, lambda e: e >= least(nlo + 200, n) AND e <= least(nlo + 250, n))), least(nlo + 250, n)) FROM (SELECT *, greatest(lo + 1, hi - 50) AS nlo FROM w WHERE hi < n))
SELECT doc_id, ord, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM w""",
    "training_chunks": f"""
WITH RECURSIVE {_DOCS}, {_TOK}, {_TAG}, u AS (SELECT tokens.doc_id, tokens.tok, tokens.token, coalesce(tag.tag, 'O') AS tag FROM tokens LEFT JOIN tag ON tokens.doc_id = tag.doc_id AND tokens.tok = tag.tok),
l AS (SELECT doc_id, list(token ORDER BY tok) AS ts, list(tag ORDER BY tok) AS gs, count(*) AS n FROM u GROUP BY doc_id),
w AS (SELECT doc_id, ts, gs, n, 0 AS k, CAST(0 AS BIGINT) AS lo, coalesce(list_min(list_filter(generate_series(120, n - 1), lambda i: gs[i + 1][1:2] <> 'I-')), n) AS hi FROM l
 UNION ALL SELECT doc_id, ts, gs, n, k + 1, hi, coalesce(list_min(list_filter(generate_series(hi + 120, n - 1), lambda i: gs[i + 1][1:2] <> 'I-')), n) FROM w WHERE hi < n)
SELECT doc_id || '#' || k AS id, ts[lo + 1 : hi] AS tokens, gs[lo + 1 : hi] AS tags FROM w""",
    "statute_clauses": """
WITH p AS (SELECT CAST(p_partkey AS INTEGER) AS n FROM part WHERE p_partkey > 0)
SELECT n AS so_dieu, 1 AS so_khoan, 2 AS points, CAST(length('Người nào làm việc này thì bị phạt tù từ 0' || (n % 3 + 1) || ' năm đến ' || (n % 3 + 5) || ' năm:' || chr(10) || 'a) Có tổ chức;' || chr(10) || 'b) Tái phạm;' || chr(10) || 'theo luật định.') AS INTEGER) AS chars FROM p
UNION ALL SELECT n, 2, 0, CAST(length('Bị phạt tiền từ ' || (n % 9 + 1) || '0.000.000 đồng đến 100.000.000 đồng hoặc phạt tù 20 năm, tù chung thân.') AS INTEGER) FROM p
UNION ALL SELECT n, 3, 0, CAST(length('Cải tạo không giam giữ đến 06 tháng.') AS INTEGER) FROM p""",
    "statute_context": """
WITH n AS (SELECT n_nationkey FROM nation), a(so_dieu, phan, chuong, muc, head, tail) AS (VALUES
 (1, 'Phần thứ nhất - NHỮNG QUY ĐỊNH CHUNG', 'Chương I - ĐIỀU KHOẢN CƠ BẢN', NULL, 'Điều 1. Một' || chr(10) || 'Thân ', chr(10) || 'xem Chương XIII' || chr(10) || 'HIỆU LỰC'),
 (2, 'Phần thứ nhất - NHỮNG QUY ĐỊNH CHUNG', 'Chương II - HIỆU LỰC', 'Mục 1. Đầu', 'Điều 2. Hai', NULL), (3, 'Phần thứ nhất - NHỮNG QUY ĐỊNH CHUNG', 'Chương II - HIỆU LỰC', 'Mục 1. Đầu', 'Điều 3. Ba' || chr(10) || 'CÁC TỘI PHẠM', NULL),
 (4, 'Phần thứ hai - CÁC TỘI PHẠM', NULL, NULL, 'Điều 4. Bốn', NULL))
SELECT n_nationkey, so_dieu, phan, chuong, muc, head || CASE WHEN tail IS NULL THEN '' ELSE n_nationkey || tail END AS text FROM n, a""",
    "precedent_records": r"""
WITH a AS (SELECT rec_no, coalesce(crimes[1], 'Trộm cắp') AS c, coalesce(facts_summary, 'không rõ') AS f FROM precedents),
b AS (SELECT rec_no, '(?i)điều\s+(\d+)' AS rx, 'Án lệ số ' || rec_no || '/2020/AL về tội danh hình sự' || chr(10) || 'Từ khóa của án lệ: “' || c || '”; “Bồi thường”' || chr(10) || 'Quy định của pháp luật liên quan đến án lệ:' || chr(10) || 'Điều 51; Điều 173' || chr(10) || chr(10) || 'NỘI DUNG VỤ ÁN' || chr(10) AS h, chr(10) || f || chr(10) AS m, c, f FROM a),
d AS (SELECT *, h || f || chr(10) || 'NHẬN ĐỊNH' || chr(10) || 'Điều 9.' AS t, regexp_extract_all('“' || string_split(c || '”; “Bồi thường”', chr(10))[1], '["“”'']([^"“”'']{2,80})["“”'']', 1) AS q FROM b),
e AS (SELECT *, regexp_extract_all(t, rx, 1) AS r, substr(t, length(regexp_extract(t, '(?is)^.*?nội\s*dung\s*vụ\s*án', 0)) + 1) AS tail FROM d)
SELECT rec_no, rec_no || '/2020/AL' AS case_number, 'hình sự' AS case_type, array_to_string(list_transform(q, lambda x: trim(x, ' ')), '|') AS crimes, array_to_string(list_transform(list_filter(r, lambda x, i: list_position(r, x) = i), lambda x: 'Điều ' || x), '|') AS articles,
 CAST(length(substr(trim(regexp_replace(regexp_extract(tail, '(?is)^(.*?)nhận\s*định', 1), '\s+', ' ', 'g'), ' '), 1, 1200)) AS INTEGER) AS facts_chars FROM e""",
    "span_money_context": rf"""
WITH a AS (SELECT rec_no, full_text AS t, unnest(regexp_extract_all(full_text, '{_MONEY}')) AS m, unnest(list_slice(string_split_regex(full_text, '{_MONEY}'), 1, len(regexp_extract_all(full_text, '{_MONEY}')))) AS g, generate_subscripts(regexp_extract_all(full_text, '{_MONEY}'), 1) AS i FROM precedents),
b AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY rec_no ORDER BY i) AS e, length(regexp_extract(m, '^[^\d]', 0)) AS pre, CASE WHEN regexp_matches(m, '(đồng|đ)$') THEN 0 ELSE 1 END AS post FROM a),
c AS (SELECT rec_no, e - length(m) + pre AS s, lower(substr(t, CAST(greatest(e - length(m) + pre - 60, 0) AS INTEGER) + 1, CAST(least(e - length(m) + pre, 60) AS INTEGER)) || ' | ' || substr(t, CAST(e - post AS INTEGER) + 1, 40)) AS near FROM b),
d AS (SELECT rec_no, s, CASE WHEN contains(near, 'án phí') OR contains(near, 'lệ phí') THEN 'COURT_FEE' WHEN contains(near, 'bồi thường') THEN 'COMPENSATION' ELSE 'MONEY_AMOUNT' END AS label FROM c)
SELECT rec_no, label, count(*) AS n, CAST(min(s) AS INTEGER) AS first_at FROM d GROUP BY ALL""",
}

_FOUND = lambda name, rx: (
    f"{name}_ AS (SELECT cit_id, unnest(regexp_extract_all(raw, '(?i){rx}')) AS m, unnest(list_slice(string_split_regex(raw, '(?i){rx}'), 1, len(regexp_extract_all(raw, '(?i){rx}')))) AS g, generate_subscripts(regexp_extract_all(raw, '(?i){rx}'), 1) AS i FROM parsed_citations WHERE raw IS NOT NULL),\n"
    f"{name} AS (SELECT cit_id, m, i, sum(length(g) + length(m)) OVER (PARTITION BY cit_id ORDER BY i) - length(m) AS s FROM {name}_)"
)
_LAW_RX = r"tố\s*tụng\s*hình\s*sự|tố\s*tụng\s*dân\s*sự|\bbộ\s*luật\s*hình\s*sự|\bbộ\s*luật\s*dân\s*sự|nghị\s*quyết|thông\s*tư|nghị\s*định|luật\s*thi\s*hành\s*án|luật\s*[\p{L}\p{N}_]|hiến\s*pháp"
_PARSED = ",\n".join((
    _FOUND("art", r"đi[eề]u\s*0*\d{1,3}"), _FOUND("cla", r"kho[aả]n\s*0*\d{1,3}"), _FOUND("poi", r"đi[eể]m\s+[a-zđ](?:\s*,\s*[a-zđ])*"), _FOUND("lw", _LAW_RX), _FOUND("code", r"bộ\s*luật\s*(?:tố\s*tụng\s*)?(?:hình|dân)\s*sự"),
    "law AS (SELECT cit_id, s FROM lw WHERE NOT EXISTS (SELECT 1 FROM code c WHERE c.cit_id = lw.cit_id AND lw.s >= c.s AND lw.s < c.s + length(c.m)) UNION SELECT cit_id, s FROM code)",
    "a AS (SELECT art.cit_id, art.i, art.s, m, coalesce(lag(art.s) OVER w, -1) AS prior, coalesce(lead(art.s) OVER w, length(raw)) AS fol, raw FROM art JOIN parsed_citations p ON p.cit_id = art.cit_id WINDOW w AS (PARTITION BY art.cit_id ORDER BY art.i))",
    "b AS (SELECT a.cit_id, a.i, max_by(c.m, c.s) AS cm FROM a LEFT JOIN cla c ON c.cit_id = a.cit_id AND c.s > prior AND c.s < a.s GROUP BY ALL), d AS (SELECT a.cit_id, a.i, max_by(p.m, p.s) AS pm FROM a LEFT JOIN poi p ON p.cit_id = a.cit_id AND p.s > prior AND p.s < a.s GROUP BY ALL)",
    "e AS (SELECT a.cit_id, a.i, min(l.s) AS l1 FROM a LEFT JOIN law l ON l.cit_id = a.cit_id AND l.s > a.s AND l.s < fol GROUP BY ALL), f AS (SELECT cit_id, max(s) AS l2 FROM law GROUP BY cit_id)",
    r"""h AS (SELECT a.cit_id, CAST(a.i - 1 AS INTEGER) AS ord, CAST(regexp_extract(m, '(\d{1,3})$', 1) AS INTEGER) AS so_dieu, TRY_CAST(regexp_extract(cm, '(\d{1,3})$', 1) AS INTEGER) AS so_khoan, substr(raw, CAST(coalesce(l1, l2) AS INTEGER) + 1, 40) AS law_text,
 CASE WHEN pm IS NULL THEN [NULL] ELSE string_split(regexp_replace(lower(pm), '^đi[eể]m\s+|\s', '', 'g'), ',') END AS letters FROM a JOIN b ON a.cit_id = b.cit_id AND a.i = b.i JOIN d ON a.cit_id = d.cit_id AND a.i = d.i JOIN e ON a.cit_id = e.cit_id AND a.i = e.i LEFT JOIN f ON a.cit_id = f.cit_id),
j AS (SELECT cit_id, so_dieu, so_khoan, unnest(letters) AS diem, law_text, ord, lower(law_text) AS l, regexp_extract(law_text, '(?i)năm\s*((?:19|20)\d{2})', 1) IN ('', '2015') AS held FROM h),
k AS (SELECT cit_id, so_dieu, so_khoan, diem, CASE WHEN coalesce(l, '') = '' THEN 'UNKNOWN' WHEN regexp_matches(l, 'tố\s*tụng\s*hình\s*sự') THEN CASE WHEN held THEN 'BLTTHS' ELSE 'OTHER' END WHEN regexp_matches(l, 'tố\s*tụng\s*dân\s*sự') THEN 'OTHER'
 WHEN regexp_matches(l, '(^|[^\p{L}])bộ\s*luật\s*hình\s*sự([^\p{L}]|$)') THEN CASE WHEN held THEN 'BLHS' ELSE 'OTHER' END WHEN regexp_matches(l, '(^|[^\p{L}])bộ\s*luật\s*dân\s*sự([^\p{L}]|$)') THEN CASE WHEN held THEN 'BLDS' ELSE 'OTHER' END
 WHEN regexp_matches(l, 'nghị\s*quyết|thông\s*tư|nghị\s*định|luật\s*[\p{L}\p{N}_]|hiến\s*pháp') THEN 'OTHER' ELSE 'UNKNOWN' END AS law, law_text, ord FROM j)""",
))
_HELD = """
v AS (SELECT DISTINCT cit_id, CASE law WHEN 'BLHS' THEN 'BLHS2015' WHEN 'BLTTHS' THEN 'BLTTHS2015' ELSE 'BLDS2015' END AS law_key, so_dieu, so_khoan, diem FROM k WHERE law IN ('BLHS', 'BLTTHS', 'BLDS')),
held AS (SELECT n AS d2, kk AS k2, NULL AS p2 FROM (SELECT n, unnest(generate_series(1, n % 7 + 1)) AS kk FROM generate_series(1, 426) t(n)) UNION ALL SELECT n, kk, unnest(['a', 'b', 'c'][1 : kk % 4]) FROM (SELECT n, unnest(generate_series(1, n % 7 + 1)) AS kk FROM generate_series(1, 426) t(n)) WHERE kk % 4 > 0),
mis AS (SELECT * FROM v WHERE NOT (so_dieu BETWEEN 1 AND 426 AND (so_khoan IS NULL OR so_khoan BETWEEN 1 AND so_dieu % 7 + 1) AND (diem IS NULL OR (so_khoan IS NOT NULL AND coalesce(list_position(['a', 'b', 'c'], diem), 9) <= so_khoan % 4)))),
nm AS (SELECT DISTINCT cit_id, law_key, so_dieu AS d, so_khoan AS kh FROM v),
ways AS (SELECT m.*, CASE WHEN n.d = m.so_dieu THEN 1 ELSE 3 END AS way, h.d2, h.k2 FROM mis m JOIN nm n ON n.cit_id = m.cit_id AND n.law_key = m.law_key AND n.kh IS NOT NULL AND (n.d <> m.so_dieu OR n.kh IS DISTINCT FROM m.so_khoan) JOIN held h ON h.d2 = n.d AND h.k2 = n.kh AND h.p2 IS NOT DISTINCT FROM m.diem
 UNION ALL SELECT m.*, 2, h.d2, h.k2 FROM mis m JOIN held h ON h.d2 = m.so_dieu AND h.p2 IS NOT DISTINCT FROM m.diem)"""
SQL |= {
    "citation_parse": f"WITH {_PARSED} SELECT cit_id, so_dieu, so_khoan, diem, law, law_text, ord FROM k",
    "citation_reattach": f"WITH {_PARSED}, {_HELD}, best AS (SELECT cit_id, law_key, so_dieu, so_khoan, diem, min({{'way': way, 'd': d2, 'k': k2}}) AS b FROM ways GROUP BY ALL) SELECT cit_id, 0 AS chain, law_key, so_dieu, so_khoan, diem, b.way AS way, CAST(b.d AS INTEGER) AS to_dieu, CAST(b.k AS INTEGER) AS to_khoan FROM best",
}

_RANKED = search._BM25("pd", "id", "text", search._TERMS).replace("w AS (", "ww AS (", 1).replace("FROM w", "FROM ww")
SQL["passage_bm25"] = f"WITH RECURSIVE {_PASSAGES}, pd AS (SELECT rec_no || '#' || chunk AS id, text FROM c), {_RANKED} SELECT k AS id, round(score, 6) AS score FROM sc ORDER BY 2 DESC, 1 LIMIT 20"
