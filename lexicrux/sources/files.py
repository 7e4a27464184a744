"""Readers and writers, and what turns raw contents into text: files, pages of a portal, recognised pages, statutes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lexicrux.functions.text import iso_date, nfc

LEAST_PDF_TEXT, LEAST_FILE_TEXT, MOST_TEXT = 200, 400, 20_000
OCR_SCHEMA = "struct<pages:array<struct<page_index:int,source_type:string,engine:string,skipped:boolean,blocks:array<struct<`order`:int,text:string,table_html:string,embedded_text:string,confidence:double>>>>>"


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content of every file below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def is_pdf(content: Column, content_type: Column | None = None) -> Column:
    magic = F.substring(F.hex(content), 1, 8) == "25504446"
    return magic if content_type is None else magic | F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf"))


def text_or_null(text: Column, least: int = LEAST_PDF_TEXT) -> Column:
    """The text layer of a file, null where it is too short to be one (a scan)."""
    return F.when(F.length(F.regexp_replace(text, r"\s+", "")) >= least, text)


@F.pandas_udf(StringType())
def docx_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of an OOXML document, a line per paragraph or table row; null for what is none."""

    def one(data: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                xml = z.read("word/document.xml").decode("utf-8", "ignore")
        except (zipfile.BadZipFile, KeyError):
            return None
        return re.sub(r"<[^>]+>", "", re.sub(r"</w:(?:p|tr)>", "\n", xml))

    for s in parts:
        yield s.map(one)


def file_kind(content: Column, text: Column) -> Column:
    """pdf-text, scan, docx, docx-fail or unknown; text: what the file's own text layer holds."""
    head = F.hex(F.substring(content, 1, 4))
    pdf = F.when(F.length(F.trim(text)) > LEAST_FILE_TEXT, "pdf-text").otherwise("scan")
    return F.when(F.startswith(head, F.lit("25504446")), pdf).when(F.startswith(head, F.lit("504B")), F.when(text.isNull(), "docx-fail").otherwise("docx")).otherwise("unknown")


def stored_text(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, "[ \t]+", " ")), 1, MOST_TEXT)


def detail_page(html: Column) -> Column:
    """Title (blanks collapsed) and first PDF link of a judgment's page; null where it has neither."""
    title = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title>\s*(.*?)\s*</title>", 1), r"\s+", " "))
    link = F.nullif(F.regexp_extract(html, r'(?i)href="(/5ta\d+[^"]*\.pdf)"', 1), F.lit(""))
    return F.when((title != "") | link.isNotNull(), F.struct(title.alias("title"), link.alias("pdf_path")))


def portal_results(pages: DataFrame, key: str, html: str, most: int = 20) -> DataFrame:
    """key, pos, case_number, date, court, href of the results a portal's page lists, the first `most`."""
    rows = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*class="[^"]*echo_id_pub[^"]*"[^>]*>.*?</a>'), F.lit(0))
    a = pages.select(key, F.posexplode(rows).alias("pos", "a")).withColumn("href", F.regexp_extract("a", r'(?i)href="([^"]*)"', 1))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("a", r"(?is)<span[^>]*>(.*?)</span>", 1), r"<[^>]+>", " "), r"\s+", " "))
    rx = r"số\s+(.+?)\s+ngày\s+(\d{1,2}/\d{1,2}/\d{4})\s+của\s+(.+?)\s*$"
    a = a.withColumn("t", F.regexp_replace(text, r"\s*\([^)]*\)\s*$", "")).where(F.col("t").rlike(rx))
    out = a.select(key, "pos", F.regexp_extract("t", rx, 1).alias("case_number"), iso_date(F.regexp_extract("t", rx, 2)).alias("date"), F.regexp_extract("t", rx, 3).alias("court"), "href")
    return out.withColumn("rn_", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("rn_") <= most).drop("rn_")


def recognised_text(doc: Column) -> Column:
    """Text and mean confidence of a recogniser's JSON: pages in order, blocks by `order`, text before table before embedded."""
    d = F.from_json(doc, OCR_SCHEMA)
    block = lambda b: F.coalesce(F.nullif(b["text"], F.lit("")), F.nullif(b["table_html"], F.lit("")), F.nullif(b["embedded_text"], F.lit("")))
    ordered = lambda p: F.array_sort(F.transform(F.coalesce(p["blocks"], F.array()), lambda b, i: F.struct(F.coalesce(b["order"], F.lit(0)).alias("o"), i.alias("i"), block(b).alias("t"))))
    page = lambda p: F.array_join(F.transform(F.filter(ordered(p), lambda b: b["t"].isNotNull()), lambda b: b["t"]), "\n")
    text = F.array_join(F.filter(F.transform(d["pages"], page), lambda x: x != ""), "\n\n")
    scans = F.filter(d["pages"], lambda p: p["source_type"] == "scan")
    conf = F.filter(F.flatten(F.transform(scans, lambda p: F.transform(F.coalesce(p["blocks"], F.array()), lambda b: b["confidence"]))), lambda x: x.isNotNull())
    mean = F.when(F.size(conf) > 0, F.round(F.aggregate(conf, F.lit(0.0), lambda s, x: s + x) / F.size(conf), 4))
    return F.struct(text.alias("text"), mean.alias("mean_confidence"), F.size(F.filter(d["pages"], lambda p: p["skipped"])).alias("skipped_pages"))


def reading_order(boxes: DataFrame, key: list[str], top: str, left: str, text: str, line: float = 18.0) -> DataFrame:
    """Lines of recognised boxes in reading order: rows of about `line` units from the top, then from the left."""
    row = F.struct(F.bround(F.col(top) / line).alias("r"), F.col(left).alias("x"), F.col(text).alias("t"))
    return boxes.where(F.trim(text) != "").groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda b: b["t"]), "\n").alias("text"))


@F.pandas_udf(ArrayType(StructType([StructField("type", StringType()), StructField("page", IntegerType()), StructField("text", StringType())])))
def structured_blocks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text-bearing nodes of a structured PDF's JSON tree, depth first in array order, list items before children."""
    import json

    def walk(nodes: list, out: list) -> None:
        todo = list(reversed(nodes or []))
        while todo:
            node = todo.pop()
            if not isinstance(node, dict):
                continue
            c = node.get("content")
            t = c.strip() if isinstance(c, str) else " ".join(str(x).strip() for x in c if x) if isinstance(c, list) else ""
            if t:
                out.append({"type": node.get("type"), "page": node.get("page number"), "text": t})
            todo += [x for part in ("kids", "list items") if isinstance(node.get(part), list) for x in reversed(node[part])]

    def one(doc: str | None) -> list:
        out: list = []
        try:
            walk((json.loads(doc) or {}).get("kids") if doc else [], out)
        except (ValueError, AttributeError):
            return []
        return out

    for s in parts:
        yield s.map(one)


def statute_clean(c: Column) -> Column:
    """Composed, hard blanks as blanks, blanks of no width gone."""
    return nfc(F.translate(c, "\u00a0\u200b", " "))


def statute_articles(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, so_dieu, phan, chuong, muc, text: the articles of statute texts with the part, chapter and section they stand in.

    A part or chapter counts where the next line is a title in capitals; a new part ends chapter and section, a new chapter
    the section; of an article given twice the first."""
    lines = pages.select(key, F.posexplode(F.filter(F.transform(F.split(statute_clean(F.col(text)), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "Đang theo dõi"))).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    after = F.lead("line").over(w)
    titled = (F.upper(after) == after) & after.rlike(r"\p{L}") & (F.length(after) > 4)
    is_article = F.regexp_extract("line", r"^Điều\s+(\d+)\.", 1).try_cast("int")
    lines = lines.withColumn("after", after).withColumn("article", is_article)
    head = lambda rx: F.when(F.col("line").rlike(rx) & titled, F.concat_ws(" - ", "line", "after"))
    lines = lines.withColumn("p", head(r"(?iu)^Phần thứ (?:nhất|hai|ba|tư|năm|sáu|bảy|tám)(?![\p{L}])")).withColumn("c", head(r"^Chương\s+[IVXLC]+\b")).withColumn("m", F.when(F.col("line").rlike(r"^Mục \d+\.?\s*\S"), F.col("line")))
    lines = lines.withColumn("phan", F.last("p", True).over(w)).withColumn("pn", F.count("p").over(w))
    wp = Window.partitionBy(key, "pn").orderBy("pos")
    lines = lines.withColumn("chuong", F.last("c", True).over(wp)).withColumn("cn", F.count("c").over(wp))
    lines = lines.withColumn("muc", F.last("m", True).over(Window.partitionBy(key, "pn", "cn").orderBy("pos"))).withColumn("nth", F.count("article").over(w))
    body = lines.where("nth > 0 AND p IS NULL AND c IS NULL AND m IS NULL")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    own = body.groupBy(key, "nth").agg(F.max("article").alias("so_dieu"), joined.alias("text"), *(F.min_by(c, "pos").alias(c) for c in ("phan", "chuong", "muc")))
    first = F.row_number().over(Window.partitionBy(key, "so_dieu").orderBy("nth"))
    return own.withColumn("rn_", first).where("rn_ = 1").select(key, "so_dieu", "phan", "chuong", "muc", "text")


def joined_fragments(rows: DataFrame, key: str, pos: str, head: str, clause: str, point: str, tail: str) -> DataFrame:
    """key, text: an article out of its fragments in order: its heading, then of each fragment the clause where it is there for
    the first time, the point and the rest; blank parts are left out."""
    cell = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    x = rows.select(key, F.col(pos).alias("p_"), cell(head).alias("h_"), cell(clause).alias("c_"), cell(point).alias("d_"), cell(tail).alias("t_"))
    first = F.row_number().over(Window.partitionBy(key, "c_").orderBy("p_")) == 1
    x = x.withColumn("c_", F.when(first, F.col("c_")))
    part = F.struct("p_", F.concat_ws("\n", "c_", "d_", "t_").alias("t"))
    g = x.groupBy(key).agg(F.min_by("h_", "p_").alias("h_"), F.array_sort(F.collect_list(part)).alias("ps"))
    return g.select(key, F.concat_ws("\n", "h_", F.nullif(F.array_join(F.filter(F.transform("ps", lambda x: x["t"]), lambda t: t != ""), "\n"), F.lit(""))).alias("text"))


def seeded(rows: DataFrame, number: str, title: str, text: str) -> DataFrame:
    """Records of precedents to be stored, of rows with their number and title and perhaps their text, each with its shown title."""
    from lexicrux.functions.cases import metadata_record

    r = metadata_record(F.col(number), F.coalesce(title, F.lit("")), F.col(text))
    name = F.concat(F.lit("Án lệ số "), F.col(number), F.coalesce(F.concat(F.lit(" — "), F.nullif(F.col(title), F.lit(""))), F.lit("")))
    return rows.where(F.col(number).isNotNull()).select(name.alias("title"), r.alias("r")).select("title", "r.*")


def of_kind(rows: DataFrame, criminal: Column, civil: Column, only: str | None = None) -> DataFrame:
    """What a crawl keeps: all, or with only = criminal or civil those of that kind."""
    return rows if only is None else rows.where(criminal if only == "criminal" else civil)


def article_blocks(text: Column) -> Column:
    """(so_dieu, text) of a file of blocks headed `=== Điều N ===`."""
    blocks = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?==== Điều \d+ ===)"), lambda b: b.rlike(r"^=== Điều \d+ ==="))
    return F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"^=== Điều (\d+) ===", 1).cast("int").alias("so_dieu"), F.trim(F.regexp_replace(F.regexp_replace(b, r"^=== Điều \d+ ===", ""), r"^\s+|\s+$", "")).alias("text")))


def as_blocks(articles: DataFrame, key: str) -> DataFrame:
    """key, text: articles (key, so_dieu, text) as one file of blocks each, by number."""
    rows = F.array_sort(F.collect_list(F.struct("so_dieu", "text")))
    return articles.groupBy(key).agg(F.concat(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("=== Điều "), r["so_dieu"].cast("string"), F.lit(" ===\n"), r["text"])), "\n\n"), F.lit("\n")).alias("text"))


def backfilled(first: DataFrame, second: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of first, and of second where first has none of the key; columns both, and which source they came from."""
    gap = second.join(first.select(*keys).distinct(), keys, "left_anti")
    return first.select(*keys, *columns).withColumn("origin", F.lit("first")).unionByName(gap.select(*keys, *columns).withColumn("origin", F.lit("second")))


# fixed values: titles about a principle, and those that name a file; what each counts, and the length that counts fully
PRINCIPLE, NAMES_FILE, WEIGHT, FULL_LENGTH = r"al\s+về|^về\s", r"^(?:quyết định|bản án|số:|quyết đinh)", 3.0, 120


def portal_links(anchors: DataFrame, key: str, title: str, href: str) -> DataFrame:
    """One record per key out of its anchors: the best title and a link. A title about a principle counts for 3, one that names
    the file against it for 3, length a little; of equals the first."""
    low = F.lower(F.col(title))
    score = F.when(low.rlike(PRINCIPLE), WEIGHT).otherwise(0.0) - F.when(low.rlike(NAMES_FILE), WEIGHT).otherwise(0.0) + F.least(F.length(title), F.lit(FULL_LENGTH)) / float(FULL_LENGTH)
    w = Window.partitionBy(key)
    ranked = anchors.withColumn("s_", score).withColumn("rn_", F.row_number().over(w.orderBy(F.desc("s_"), "pos"))).withColumn("href_", F.first(href, True).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    clean = F.trim(F.regexp_replace(title, r"^Án lệ số\s*\d+/\d{4}/AL\s*", ""))
    return ranked.where("rn_ = 1").select(key, F.coalesce(F.nullif(clean, F.lit("")), F.col(title)).alias("title"), F.col("href_").alias("href"))


def fragments(text: Column, size: int = 280) -> Column:
    """A text in pieces of `size` characters, as it is sent on."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(size)), lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
