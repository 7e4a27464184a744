"""Problem 7: lines that a site puts into many of its documents.

Every line goes down a token tree of fixed depth: site, number of tokens, first DEPTH tokens (tokens with a digit and
initials are slots at once). In the leaf node it ends at, the line's tokens are taken as PLACES runs of equal length (single
tokens in lines of up to PLACES); every place keeps the tokens that SHARE of the node's lines have there, and becomes a
wildcard slot for the others: that is the line's template. Trees are counted in each
partition and merged by adding up the counts of equal places, so that templates don't depend on how rows are spread.
Templates that cover fewer than least_docs documents of the site are dropped; what remains is

- checked line by line for lines that repeat as they are (`repeated`), or
- taken as it is for lines with changing fields, names and dates (`templated`): of templates in which at least FIXED of the
  tokens are no slots.

Equal lines have equal templates, which cover all documents the line is in: no repeated line is lost.

Defined results: null sites and null or empty texts have no lines; a blank site is a site of its own; a key repeated counts
once; lines shorter than `least_chars` after normalisation are never cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicrux.staging import stage, unstage

DEPTH, PLACES = 3, 16
SHARE, FIXED = 0.3, 0.6
LEAST_CHARS, LEAST_DOCS = 30, 4
SLOT = r"[^ ]*[0-9][^ ]*|(?<![^ ])(?:\p{L}\.)+\p{L}(?![^ ])"


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, "[ \t]+", " ")))


def parsed(docs: DataFrame, key: str, site: str, text: str, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Lines as leaves: key, line_no, hash of the line, node of the tree, hashes of its places (0: a slot at once)."""
    lines = docs.where(F.col(site).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(site).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    # a line cannot grow by normalisation (a few letters may, by one character each): short ones go before the costly part
    lines = lines.where(F.length("raw") * 2 >= least_chars).withColumn("line", normal(F.col("raw"))).where(F.length("line") >= least_chars)
    tokens = F.split(F.regexp_replace("line", SLOT, "<*>"), " ")
    lines = lines.select("k", (F.col("pos") + 1).cast("int").alias("line_no"), "site", F.xxhash64("line").alias("line"), tokens.alias("t"))
    node = F.xxhash64("site", F.size("t"), F.slice("t", 1, DEPTH)).alias("node")
    step = F.ceil(F.size("t") / PLACES).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("t") / step).cast("int") - 1), lambda i: F.slice("t", i * step + 1, step))
    return lines.select("k", "line_no", F.xxhash64("site", "line").alias("line"), node, F.transform(runs, lambda x: F.when(x == F.array(F.lit("<*>")), 0).otherwise(F.hash(x))).alias("toks"))


def templated(docs: DataFrame, key: str = "rec_no", site: str = "court", text: str = "full_text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Lines under templates that cover at least least_docs documents of their site: key, line_no, line (hash), template,
    docs, fixed (the share of tokens that are no slots)."""
    leaves = stage(parsed(docs, key, site, text, least_chars))
    # counting rows first keeps the merge of the trees to one small row a node and partition
    nodes = stage(leaves.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs))
    under = stage(leaves.join(nodes, "node", "left_semi"))
    places = under.select("node", F.posexplode("toks").alias("pos", "tok")).groupBy("node", "pos", "tok").agg(F.count("*").alias("c"))
    # at most 1 / SHARE tokens are kept of a place, so that no list grows with the data
    often = (F.col("c") >= F.greatest(F.lit(least_docs), F.col("n") * SHARE)) & (F.col("tok") != 0)
    kept = places.join(nodes, "node").groupBy("node", "pos").agg(F.collect_list(F.when(often, F.col("tok"))).alias("kept"))
    kept = kept.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kept"))), lambda x: x["kept"]).alias("kept"))
    shown = F.zip_with("toks", "kept", lambda t, k: F.when(F.array_contains(k, t), t))
    lines = stage(
        under.join(kept, "node").withColumn("shown", shown).select("k", "line_no", "line", F.xxhash64("node", "shown").alias("template"), (F.size(F.array_compact("shown")) / F.size("shown")).alias("fixed"))
    )
    covering = lines.groupBy("template").agg(F.count_distinct("k").alias("docs")).where(F.col("docs") >= least_docs)
    out = stage(lines.join(covering, "template").select(F.col("k").alias(key), "line_no", "line", "template", "docs", "fixed"))
    unstage(leaves, nodes, under, lines)
    return out


def repeated(docs: DataFrame, key: str = "rec_no", site: str = "court", text: str = "full_text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Every line (key, line_no) that occurs as it is in at least least_docs documents of its site."""
    under = templated(docs, key, site, text, least_docs, least_chars)
    seen = under.groupBy("line").agg(F.count_distinct(key).alias("docs")).where(F.col("docs") >= least_docs)
    return under.join(seen.select("line"), "line", "left_semi").select(key, "line_no").distinct()


def without(docs: DataFrame, lines: DataFrame, key: str = "rec_no", text: str = "full_text") -> DataFrame:
    """key, clean_text, removed_lines: the documents without the given lines."""
    gone = lines.groupBy(key).agg(F.collect_set("line_no").alias("gone"))
    own = docs.select(F.col(key), F.col(text).alias("text_")).join(gone, key, "left")
    numbered = F.transform(F.split("text_", "\n"), lambda x, i: F.when(~F.array_contains(F.col("gone"), (i + 1).cast("int")), x))
    return own.select(key, F.when(F.col("gone").isNull(), F.col("text_")).otherwise(F.array_join(F.array_compact(numbered), "\n")).alias("clean_text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed_lines"))


def p7_found(spark, d: str) -> DataFrame:
    return repeated(spark.read.parquet(f"{d}/precedents.parquet"))


def p7_cleaned(spark, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/precedents.parquet")
    return without(docs, repeated(docs))


def p7_templates(spark, d: str) -> DataFrame:
    """Lines of templates with or without changing fields: rec_no, line_no, docs of the template, fixed share."""
    lines = templated(spark.read.parquet(f"{d}/precedents.parquet")).where(F.col("fixed") >= FIXED)
    return lines.select("rec_no", "line_no", "docs", F.round("fixed", 4).alias("fixed")).distinct()


def p7_removed(spark, d: str) -> DataFrame:
    """The documents without lines that repeat, changing fields or not."""
    docs = spark.read.parquet(f"{d}/precedents.parquet")
    under = templated(docs)
    seen = under.groupBy("line").agg(F.count_distinct("rec_no").alias("n")).where(F.col("n") >= LEAST_DOCS)
    gone = under.join(seen, "line", "left").where((F.col("fixed") >= FIXED) | F.col("n").isNotNull()).select("rec_no", "line_no")
    return without(docs, gone)


_LINES = r"""
WITH l AS (
  SELECT rec_no, court, unnest(string_split(full_text, chr(10))) AS raw, generate_subscripts(string_split(full_text, chr(10)), 1) AS line_no
  FROM precedents WHERE court IS NOT NULL AND full_text IS NOT NULL),
n AS (SELECT rec_no, court, line_no, lower(trim(regexp_replace(raw, '[ \t]+', ' ', 'g'), ' ')) AS line FROM l),
s AS (SELECT court, line FROM n WHERE length(line) >= 30 GROUP BY court, line HAVING count(DISTINCT rec_no) >= 4)
"""
QUERIES = {"p7_found": p7_found, "p7_cleaned": p7_cleaned, "p7_templates": p7_templates, "p7_removed": p7_removed}
SQL = {
    "p7_found": _LINES + "SELECT DISTINCT rec_no, CAST(line_no AS INTEGER) AS line_no FROM n JOIN s USING (court, line)",
    "p7_cleaned": _LINES
    + r""", bad AS (SELECT DISTINCT rec_no, line_no FROM n JOIN s USING (court, line)),
kept AS (SELECT l.rec_no, string_agg(raw, chr(10) ORDER BY l.line_no) FILTER (b.rec_no IS NULL) AS t, count(b.rec_no) AS c
         FROM l LEFT JOIN bad b ON b.rec_no = l.rec_no AND b.line_no = l.line_no GROUP BY l.rec_no)
SELECT p.rec_no, CASE WHEN k.c > 0 THEN coalesce(k.t, '') ELSE p.full_text END AS clean_text, CAST(coalesce(k.c, 0) AS INTEGER) AS removed_lines
FROM precedents p LEFT JOIN kept k ON p.rec_no = k.rec_no""",
}
