"""Queries of sources and case records, over contents built by rule from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexicrux.functions import cases as C
from lexicrux.operators import jobs as J
from lexicrux.plans.spans import entity_spans
from lexicrux.sources import files as S


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def page_title_links(spark, d):
    html = F.concat(F.lit("<html><head><title>\n  "), F.regexp_replace("title", " ", "  "), F.lit(" </title></head><a href=\"/3ta.pdf\"></a><A HREF=\"/5ta"), F.col("rec_no").cast("string"), F.lit("t1.pdf\">tải</a>"))
    p = _t(spark, d, "precedents").select("rec_no", S.detail_page(F.coalesce(html, F.lit("<html></html>"))).alias("x"))
    return p.select("rec_no", "x.title", "x.pdf_path")


def portal_listing(spark, d):
    row = lambda n: F.concat(F.lit(f'<a class="btn echo_id_pub" href="/ct/{n}"><span>Bản án: số  '), F.col("case_number"), F.lit(" ngày 3/11/2019 của <b>"), F.col("court"), F.lit("</b> (01.06.2020)</span></a>"))
    p = _t(spark, d, "precedents").where("case_number LIKE '%/%' AND trim(case_number) = case_number AND court IS NOT NULL").select("rec_no", F.concat(row(1), F.lit("<a href='/x'>x</a>"), row(2)).alias("html"))
    return S.portal_results(p, "rec_no", "html")


def recognised_pages(spark, d):
    doc = F.to_json(F.struct(F.array(
        F.struct(F.lit(0).alias("page_index"), F.lit("scan").alias("source_type"), F.lit("e").alias("engine"), F.lit(False).alias("skipped"), F.array(F.struct(F.lit(2).alias("order"), F.col("engine").alias("text"), F.lit(0.5).alias("confidence")), F.struct(F.lit(1).alias("order"), F.col("precedent_id").alias("text"), F.lit(0.75).alias("confidence"))).alias("blocks")),
        F.struct(F.lit(1).alias("page_index"), F.lit("digital").alias("source_type"), F.lit("e").alias("engine"), F.lit(True).alias("skipped"), F.array(F.struct(F.lit(1).alias("order"), F.lit("").alias("text"), F.lit(1.0).alias("confidence"))).alias("blocks")),
    ).alias("pages")))
    o = _t(spark, d, "ocr_results").select("ocr_id", S.recognised_text(doc).alias("r"))
    return o.select("ocr_id", "r.text", "r.mean_confidence", "r.skipped_pages")


def box_order(spark, d):
    b = _t(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 90).cast("double").alias("y"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).cast("double").alias("x"), F.concat_ws("-", "l_returnflag", F.col("l_linenumber").cast("string")).alias("t"))
    return S.reading_order(b, ["l_orderkey"], "y", "x", "t")


def statute_context(spark, d):
    """Articles with part, chapter and section of a statute text built by rule: one text per nation."""
    n = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("Lời nói đầu\nPhần thứ nhất\nNHỮNG QUY ĐỊNH CHUNG\nChương I\nĐIỀU KHOẢN CƠ BẢN\nĐiều 1. Một\nThân "), n, F.lit("\nxem Chương XIII\nChương II\nHIỆU LỰC\nMục 1. Đầu\nĐiều 2. Hai\nĐiều 3. Ba\nPhần thứ hai\nCÁC TỘI PHẠM\nĐiều 4. Bốn\nĐiều 2. Lặp"))
    return S.statute_articles(_t(spark, d, "nation").select("n_nationkey", text.alias("text")), "n_nationkey", "text")


def article_block_files(spark, d):
    """Articles written as one file of blocks and read back."""
    a = _t(spark, d, "part").where("p_partkey > 0").select((F.col("p_partkey") % 5).alias("law"), F.col("p_partkey").cast("int").alias("so_dieu"), F.col("p_name").alias("text"))
    return S.as_blocks(a, "law").select("law", F.explode(S.article_blocks(F.col("text"))).alias("b")).select("law", "b.so_dieu", "b.text")


def source_backfill(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return S.backfilled(o.where("o_orderstatus = 'F'"), o, ["o_orderkey"], ["o_orderstatus"])


def answer_fragments(spark, d):
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(S.fragments(F.col("text"))).alias("ord", "part"))


def enriched_text(spark, d):
    p = _t(spark, d, "precedents")
    todo = J.to_do(p.select("rec_no", "full_text"), p.where("facts_summary IS NULL").select("rec_no"), "rec_no")
    return todo.select("rec_no", S.stored_text(F.col("full_text")).alias("text"))


def precedent_records(spark, d):
    """Precedent records of texts built by rule: number, keywords, law section, facts."""
    text = F.concat(F.lit("Án lệ số "), F.col("rec_no").cast("string"), F.lit("/2020/AL về tội danh hình sự\nTừ khóa của án lệ: “"), F.coalesce(F.try_element_at("crimes", F.lit(1)), F.lit("Trộm cắp")), F.lit("”; “Bồi thường”\nQuy định của pháp luật liên quan đến án lệ:\nĐiều 51; Điều 173\n\nNỘI DUNG VỤ ÁN\n"), F.coalesce("facts_summary", F.lit("không rõ")), F.lit("\nNHẬN ĐỊNH\nĐiều 9."))
    p = _t(spark, d, "precedents").select("rec_no", text.alias("text"))
    return C.precedent(p, "rec_no", "text").select("rec_no", "case_number", "case_type", F.array_join("crimes", "|").alias("crimes"), F.array_join("articles", "|").alias("articles"), F.length("facts_summary").alias("facts_chars"))


def bucket_by_label(spark, d):
    s = _t(spark, d, "gold_spans").select("id", F.explode("spans").alias("s")).select("id", "s.label", "s.start", "s.text")
    return C.first_texts(s, "id", 6).select("id", "label", F.array_join("texts", "|").alias("texts"))


def case_questions(spark, d):
    """What a question about a case takes from its spans: penalty, offence basis, applied citations."""
    t = C.first_texts(entity_spans(spark, d), "doc_id").groupBy("doc_id").pivot("label", ["PENALTY", "LEGAL_BASIS"]).agg(F.first("texts"))
    none = F.array().cast("array<string>")
    basis = C.offence_basis(F.coalesce("LEGAL_BASIS", none))
    return t.select("doc_id", C.pronounced_penalty(F.coalesce("PENALTY", none)).alias("penalty"), basis.alias("basis"), C.applied_citations(basis).alias("applied"))


def citation_pairs(spark, d):
    return C.pairs(entity_spans(spark, d), "doc_id")


def corpus_check(spark, d):
    """Pairs of article and law against titles of a corpus built from the cited laws."""
    c = _t(spark, d, "parsed_citations").where("law_text IS NOT NULL AND so_dieu IS NOT NULL")
    hits = c.select(F.concat(F.lit("Điều "), F.col("so_dieu").cast("string")).alias("article"), F.concat(F.lit("Văn bản hợp nhất "), F.col("law_text")).alias("title"))
    return C.checked_pairs(citation_pairs(spark, d), hits, "doc_id")


def conversation_context(spark, d):
    e = _t(spark, d, "events").where("user_id IS NOT NULL")
    turns = e.select("user_id", F.col("event_id").alias("turn"), F.when(F.col("event_type") == "view", "assistant").otherwise("user").alias("role"), F.col("event_type").alias("text"))
    q = C.retrieval_query(turns, "user_id")
    return q.select("user_id", "query", F.coalesce(F.size("history"), F.lit(0)).alias("history"))


QUERIES = {f.__name__: f for f in (page_title_links, portal_listing, recognised_pages, box_order, statute_context, article_block_files, source_backfill, answer_fragments, enriched_text, precedent_records, bucket_by_label, case_questions, citation_pairs, corpus_check, conversation_context)}
SQL = {
    "page_title_links": "SELECT rec_no, coalesce(trim(regexp_replace(title, ' +', ' ', 'g')), NULL) AS title, CASE WHEN title IS NOT NULL THEN '/5ta' || rec_no || 't1.pdf' END AS pdf_path FROM precedents",
    "portal_listing": "SELECT rec_no, n AS pos, case_number, '2019-11-03' AS date, trim(regexp_replace(court, ' +', ' ', 'g')) AS court, h AS href FROM precedents, (VALUES (0, '/ct/1'), (1, '/ct/2')) t(n, h) WHERE case_number LIKE '%/%' AND trim(case_number) = case_number AND court IS NOT NULL",
    "recognised_pages": "SELECT ocr_id, CASE WHEN coalesce(precedent_id, '') = '' THEN coalesce(engine, '') WHEN coalesce(engine, '') = '' THEN precedent_id ELSE precedent_id || chr(10) || engine END AS text, CAST(0.625 AS DOUBLE) AS mean_confidence, 1 AS skipped_pages FROM ocr_results",
    "box_order": "SELECT l_orderkey, string_agg(l_returnflag || '-' || l_linenumber, chr(10) ORDER BY round_even((l_partkey % 90) / 18.0, 0), l_suppkey * 10 + l_linenumber, l_returnflag || '-' || l_linenumber) AS text FROM lineitem GROUP BY l_orderkey",
    "article_block_files": "SELECT p_partkey % 5 AS law, CAST(p_partkey AS INTEGER) AS so_dieu, p_name AS text FROM part WHERE p_partkey > 0",
    "source_backfill": "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'first' ELSE 'second' END AS origin FROM orders",
    "answer_fragments": "WITH a AS (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 280)) AS i FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(i AS INTEGER) AS ord, substr(text, i * 280 + 1, 280) AS part FROM a",
    "enriched_text": r"SELECT rec_no, substr(trim(regexp_replace(full_text, '[ \t]+', ' ', 'g'), ' '), 1, 20000) AS text FROM precedents WHERE facts_summary IS NOT NULL",
    "bucket_by_label": "WITH s AS (SELECT id, unnest(spans) AS s FROM gold_spans), f AS (SELECT id, s.label AS label, trim(s.text, ' ') AS t, min(s.start) AS p FROM s WHERE trim(s.text, ' ') <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY p) AS r FROM f) SELECT id, label, string_agg(t, '|' ORDER BY r) AS texts FROM r WHERE r <= 6 GROUP BY id, label",
    "conversation_context": "WITH t AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE user_id IS NOT NULL), b AS (SELECT user_id, max_by(event_type, event_id) AS b FROM t WHERE r > 1 AND event_type <> 'view' GROUP BY 1) SELECT t.user_id, concat_ws(' ', b, t.event_type) AS query, CAST((SELECT count(*) FROM t h WHERE h.user_id = t.user_id AND h.r BETWEEN 2 AND 7) AS INTEGER) AS history FROM t LEFT JOIN b USING (user_id) WHERE r = 1",
}
