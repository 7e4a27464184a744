"""Queries of files and stores whose contents are written first and read back: PDF, DOCX, JSON lines, links, chunks."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lexicrux.operators import forgery as G
from lexicrux.operators import law as L
from lexicrux.operators import retrieval as R
from lexicrux.plans import proofs, texts
from lexicrux.plans.records import _KINDS
from lexicrux.sources import files as Files
from lexicrux.sources import pdf as P
from lexicrux.staging import shared_dir
from lexicrux.streaming.jobs import ingest, log_states


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def pdf_bytes(no: int, texts: list[str]) -> bytes:
    """A small PDF with a page per text: codes are UTF-16 units, every second stream is compressed, every third page turned."""
    cmap = b"1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /BaseFont /Serif /ToUnicode 4 0 R >>", 4: b"<< /Length %d >> stream\n%s\nendstream" % (len(cmap), cmap), 5: b"<< /Type /Annot /Subtype /Stamp >>"}
    kids = []
    for i, t in enumerate(texts):
        n = 10 + 2 * i
        body = b"BT /F1 12 Tf " + b" 0 -14 Td ".join(b"<" + line.encode("utf-16-be").hex().encode() + b"> Tj" for line in t.split("\n")) + b" ET"
        packed, how = (zlib.compress(body), b" /Filter /FlateDecode") if (no + i) % 2 else (body, b"")
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >>%s%s >>" % (n + 1, b" /Rotate 90" if i % 3 == 2 else b"", b" /Annots [5 0 R]" if no % 5 == 0 else b"")
        objects[n + 1] = b"<< /Length %d%s >> stream\n%s\nendstream" % (len(packed), how, packed)
        kids.append(b"%d 0 R" % n)
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 595 842] >>" % (b" ".join(kids), len(kids))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objects.items())) + b"%%EOF"


@F.pandas_udf(BinaryType())
def _pdfs(no: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for ids, texts in no:
        yield pd.Series([b"no file" if t is None else pdf_bytes(i, [t[:300], t[300:600] or "-", "x"]) for i, t in zip(ids, texts)])


@F.pandas_udf(BinaryType())
def _docx(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(t: str | None) -> bytes:
        if t is None:
            return b"PK\x03\x04"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", "<w:document>" + "".join(f"<w:p><w:t>{x}</w:t></w:p>" for x in t.replace("&", " ").replace("<", " ").replace(">", " ").split("\n")) + "</w:document>")
        return out.getvalue()

    for s in parts:
        yield s.map(one)


def _plain():
    return F.regexp_replace("full_text", r"[^\n -~À-ỹ]", " ")


def _read(spark, d):
    p = _t(spark, d, "precedents").select("rec_no", _pdfs("rec_no", _plain()).alias("content"))
    return p.select("rec_no", P.pages_of("content").alias("f"))


def pdf_texts(spark, d):
    """Text of files written as PDF and read back: the layer, or what a recogniser gives for scans, or an error."""
    x = _read(spark, d).select("rec_no", F.col("f.error").alias("error"), F.size("f.pages").alias("pages"), P.layer(F.col("f.pages")).alias("l"), P.extracted(F.col("f.pages"), F.when(F.col("rec_no") % 2 == 0, "nhận dạng")).alias("e"))
    return x.select("rec_no", "error", "pages", "l.text", "l.is_scanned", F.col("e.source").alias("source"), F.col("e.error").alias("text_error"))


def pdf_features(spark, d):
    """Features of every page: fonts, size, rotation, marks, images."""
    return _read(spark, d).select("rec_no", F.explode("f.pages").alias("p")).select("rec_no", "p.page", F.array_join("p.fonts", ",").alias("fonts"), "p.width", "p.height", "p.rotation", "p.images", F.array_join("p.annots", ",").alias("annots"))


def docx_texts(spark, d):
    p = _t(spark, d, "precedents").select("rec_no", _docx(_plain()).alias("content"))
    text = Files.docx_text(F.col("content"))
    return p.select("rec_no", text.alias("text"))


def json_lines(spark, d):
    """Records written as JSON lines into the shared folder and read back."""
    at = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    Files.write_jsonl(_t(spark, d, "precedents").select("rec_no", "id", "title", "crimes"), at)
    back = Files.jsonl(spark, at, "rec_no BIGINT, id STRING, title STRING, crimes ARRAY<STRING>")
    return back.select("rec_no", "id", "title", F.size("crimes").alias("crimes"))


def link_titles(spark, d):
    """One record out of each judgment's anchors: number first, then what it is about, and a link that comes late."""
    a = lambda pos, title, href: F.struct(F.lit(pos).alias("pos"), title.alias("title"), href.cast("string").alias("href"))
    p = _t(spark, d, "precedents").where("title IS NOT NULL")
    anchors = F.array(a(0, F.concat(F.lit("Bản án "), F.col("rec_no").cast("string")), F.lit(None)), a(1, F.concat(F.lit("Án lệ số "), F.col("rec_no").cast("string"), F.lit("/2020/AL về "), F.col("title")), F.concat(F.lit("/f/"), F.col("rec_no").cast("string"))), a(2, F.lit("khác"), F.lit("/z")))
    return Files.portal_links(p.select("rec_no", F.explode(anchors).alias("a")).select("rec_no", "a.*"), "rec_no", "title", "href")


def charges_of_any(spark, d):
    """Whether one of a judgment's crimes is the offence of one of the titles it may be of."""
    p = _t(spark, d, "precedents")
    return p.select("rec_no", L.charge_of_any(F.col("crimes"), F.array(F.regexp_extract("title", r"về (tội .*)$", 1), F.col("case_type"))).alias("match"))


def chunk_store(spark, d):
    """Passages of texts by what they hold, made once: those of the pages, then of the judgments, equal texts from the store."""
    docs = lambda name, text: _t(spark, d, name).where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    store = R.chunked(docs("ocr_results", "text"), "text", None)
    every = R.chunked(docs("ocr_results", "text").unionByName(docs("precedents", "full_text")), "text", store)
    return every.groupBy("made").agg(F.count_distinct("hash").alias("texts"), F.count("*").alias("chunks"))


@F.pandas_udf(BinaryType())
def _pixels(no: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A page of 1,000 pixels of which a line number's worth is red; the pages of some suppliers have none."""
    for lines, supp in no:
        yield pd.Series([None if s % 4 == 0 else bytes([200, 20, 20]) * int(n) + bytes([90, 90, 90]) * (1000 - int(n)) for n, s in zip(lines, supp)])


def seal_regions(spark, d):
    """Pages with a red region, and documents with images but none."""
    li = _t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("page"), _pixels("l_linenumber", "l_suppkey").alias("px"))
    docs = G.seal_pages(li, "l_orderkey", "page", "px")
    return docs.join(G.seal_findings(docs, "l_orderkey"), "l_orderkey", "left").select("l_orderkey", "images", F.size("seal_pages").alias("seals"), "signal")


def fragment_articles(spark, d):
    """Articles put together from fragments, a clause's text once."""
    li = _t(spark, d, "lineitem").select("l_orderkey", ((F.col("l_partkey") * 100_000 + F.col("l_suppkey")) * 100 + F.col("l_linenumber") * 2 + (F.col("l_linestatus") == "O").cast("int")).alias("pos"), F.concat(F.lit("Điều "), F.col("l_orderkey").cast("string"), F.lit(".")).alias("head"), F.col("l_returnflag").alias("clause"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).otherwise(" ").alias("point"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("tail"))
    return Files.joined_fragments(li, "l_orderkey", "pos", "head", "clause", "point", "tail")


def seed_records(spark, d):
    p = _t(spark, d, "precedents").select("case_number", "title", F.lit("").alias("text"))
    return Files.seeded(p, "case_number", "title", "text").groupBy("title", "case_type", "facts_summary").agg(F.count("*").alias("n"))


def crawl_kept(spark, d):
    """How many judgments a crawl of one kind keeps, and of how many sources."""
    c = texts.crawl_classify(spark, d).join(_t(spark, d, "precedents").select("rec_no", "source"), "rec_no")
    kept = lambda only: Files.of_kind(c, F.col("criminal"), F.col("civil"), only).groupBy("source").agg(F.count("*").alias("kept")).select(F.lit(only or "all").alias("only"), "source", "kept")
    return kept(None).unionByName(kept("criminal")).unionByName(kept("civil"))


def ingested_events(spark, d):
    """Events taken in by a stream from files, in two runs over the same checkpoint: each once."""
    at = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    schema = "event_id BIGINT, user_id BIGINT, event_type STRING"
    own = _t(spark, d, "events").select("event_id", F.col("user_id").cast("bigint").alias("user_id"), "event_type")
    own.where("event_type = 'view'").write.parquet(f"{at}/in")
    for more in (True, False):
        ingest(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint", schema)
        if more:
            own.where("event_type IS NULL OR event_type <> 'view'").write.mode("append").parquet(f"{at}/in")
    return spark.read.schema(schema).parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("different"))


def streamed_jobs(spark, d):
    """States of jobs kept by a stream over a log of steps, some late and some twice, by their last change."""
    at = f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}"
    o = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.explode(F.array(F.struct(F.lit("queued").alias("status"), F.lit(0).cast("bigint").alias("seq")), F.struct(F.lit("running").alias("status"), F.lit(1).cast("bigint").alias("seq")), F.struct(F.lit("running").alias("status"), F.lit(1).cast("bigint").alias("seq")), F.struct(F.when(F.col("o_orderstatus") == "F", "error").otherwise("done").alias("status"), F.lit(2).cast("bigint").alias("seq")))).alias("s")).select("job_id", "s.*")
    o.write.parquet(f"{at}/in")
    log_states(spark.readStream.schema("job_id STRING, status STRING, seq BIGINT").parquet(f"{at}/in"), f"{at}/out", f"{at}/checkpoint")
    last = spark.read.parquet(f"{at}/out").groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("events").alias("events"))
    return last.groupBy("status", "events").agg(F.count("*").alias("jobs"))


QUERIES = {f.__name__: f for f in (seal_regions, fragment_articles, seed_records, crawl_kept, ingested_events, streamed_jobs, pdf_texts, pdf_features, docx_texts, json_lines, link_titles, charges_of_any, chunk_store)}

_TEXT = r"t AS (SELECT rec_no, regexp_replace(full_text, '[^\n -~À-ỹ]', ' ', 'g') AS t FROM precedents)"
_CUTS = proofs._PASSAGES.replace("FROM precedents WHERE full_text IS NOT NULL", "FROM every").replace("SELECT rec_no, list_filter", "SELECT hash AS rec_no, list_filter", 1)
SQL = {
    "seal_regions": "WITH p AS (SELECT l_orderkey, l_suppkey % 4 <> 0 AS i, l_suppkey % 4 <> 0 AND l_linenumber > 4 AS r FROM lineitem), g AS (SELECT l_orderkey, CAST(count(*) FILTER (i) AS INTEGER) AS images, CAST(count(*) FILTER (r) AS INTEGER) AS seals FROM p GROUP BY l_orderkey) SELECT *, CASE WHEN images > 0 AND seals = 0 THEN 'seal.absent_low_confidence' END AS signal FROM g",
    "fragment_articles": """
WITH a AS (SELECT l_orderkey, (l_partkey * 100000 + l_suppkey) * 100 + l_linenumber * 2 + CAST(l_linestatus = 'O' AS INTEGER) AS pos, l_returnflag AS c, CASE WHEN l_linenumber % 2 = 0 THEN nullif(trim(l_linestatus), '') END AS p, 't' || l_partkey AS t, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY (l_partkey * 100000 + l_suppkey) * 100 + l_linenumber * 2 + CAST(l_linestatus = 'O' AS INTEGER)) AS r FROM lineitem),
b AS (SELECT l_orderkey, pos, concat_ws(chr(10), CASE WHEN r = 1 THEN nullif(trim(c), '') END, p, t) AS x FROM a) SELECT l_orderkey, 'Điều ' || l_orderkey || '.' || chr(10) || string_agg(x, chr(10) ORDER BY pos, x) AS text FROM b GROUP BY l_orderkey""",
    "seed_records": f"WITH a AS (SELECT 'Án lệ số ' || case_number || coalesce(' — ' || nullif(title, ''), '') AS title, {_KINDS("coalesce(title, '')")} AS case_type, coalesce(nullif(trim(coalesce(title, ''), '. '), ''), coalesce(title, '')) AS facts_summary FROM precedents WHERE case_number IS NOT NULL) SELECT title, case_type, facts_summary, count(*) AS n FROM a GROUP BY ALL",
    "crawl_kept": f"WITH k AS ({texts.SQL['crawl_classify']}), a AS (SELECT source, criminal, civil FROM k JOIN precedents USING (rec_no)) SELECT 'all' AS only, source, count(*) AS kept FROM a GROUP BY source UNION ALL SELECT 'criminal', source, count(*) FROM a WHERE criminal GROUP BY source UNION ALL SELECT 'civil', source, count(*) FROM a WHERE civil GROUP BY source",
    "ingested_events": "SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS different FROM events GROUP BY event_type",
    "streamed_jobs": "SELECT CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'done' END AS status, CAST(3 AS BIGINT) AS events, count(*) AS jobs FROM orders GROUP BY 1",
    "chunk_store": f"WITH RECURSIVE known AS (SELECT DISTINCT sha1(text) AS hash FROM ocr_results WHERE text IS NOT NULL), every AS (SELECT DISTINCT sha1(full_text) AS hash, full_text FROM (SELECT text AS full_text FROM ocr_results UNION ALL SELECT full_text FROM precedents) WHERE full_text IS NOT NULL), {_CUTS} "
    "SELECT CASE WHEN hash IS NULL THEN 'new' ELSE 'kept' END AS made, count(DISTINCT rec_no) AS texts, count(*) AS chunks FROM c LEFT JOIN known ON rec_no = hash GROUP BY 1",
    "pdf_texts": rf"WITH {_TEXT}, u AS (SELECT rec_no, substr(t, 1, 300) || chr(10) || chr(10) || coalesce(nullif(substr(t, 301, 300), ''), '-') || chr(10) || chr(10) || 'x' || chr(10) AS x FROM t), v AS (SELECT *, length(regexp_replace(coalesce(x, ''), '\s+', '', 'g')) < 200 AS s FROM u) "
    "SELECT rec_no, CASE WHEN x IS NULL THEN 'not_pdf' END AS error, CASE WHEN x IS NULL THEN 0 ELSE 3 END AS pages, coalesce(x, '') AS text, s AS is_scanned, CASE WHEN NOT s THEN 'text_layer' WHEN rec_no % 2 = 0 THEN 'recognised' END AS source, CASE WHEN s AND rec_no % 2 <> 0 THEN 'scan_without_text' END AS text_error FROM v",
    "pdf_features": "SELECT rec_no, CAST(p AS INTEGER) AS page, 'Serif' AS fonts, 595.0::DOUBLE AS width, 842.0::DOUBLE AS height, CAST(CASE WHEN p = 2 THEN 90 ELSE 0 END AS INTEGER) AS rotation, 0 AS images, CASE WHEN rec_no % 5 = 0 THEN 'Stamp' ELSE '' END AS annots FROM precedents, range(3) r(p) WHERE full_text IS NOT NULL",
    "docx_texts": rf"WITH {_TEXT} SELECT rec_no, replace(replace(replace(t, '&', ' '), '<', ' '), '>', ' ') || chr(10) AS text FROM t",
    "json_lines": "SELECT rec_no, id, title, CAST(len(crimes) AS INTEGER) AS crimes FROM precedents",
    "link_titles": "SELECT rec_no, 'về ' || title AS title, '/f/' || rec_no AS href FROM precedents WHERE title IS NOT NULL",
    "charges_of_any": r"""
WITH f AS (SELECT rec_no, unnest(crimes) AS c, [coalesce(regexp_extract(title, 'về (tội .*)$', 1), ''), coalesce(case_type, '')] AS ts FROM precedents), g AS (SELECT rec_no, c, unnest(ts) AS t FROM f WHERE c IS NOT NULL),
h AS (SELECT rec_no, c, t, trim(replace(strip_accents(replace(lower(c), 'đ', chr(1))), chr(1), 'đ'), ' ') AS cf, regexp_replace(trim(replace(strip_accents(replace(lower(t), 'đ', chr(1))), chr(1), 'đ'), ' '), '^toi\s+', '') AS tf FROM g),
k AS (SELECT rec_no, bool_or(c <> '' AND t <> '' AND length(cf) >= 4 AND (contains(tf, cf) OR contains(cf, tf) OR len(list_intersect(list_distinct(string_split_regex(cf, '\s+')), list_distinct(string_split_regex(tf, '\s+')))) / len(list_distinct(string_split_regex(cf, '\s+'))) >= 0.7)) AS m FROM h GROUP BY rec_no)
SELECT rec_no, CASE WHEN m THEN 'true' ELSE 'uncertain' END AS match FROM precedents LEFT JOIN k USING (rec_no)""",
}
