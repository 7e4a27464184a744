"""Records and question texts of cases, from their text and their spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicrux.functions import text as T

# fixed values: what names the kind of a case, in the order it is tried
KINDS = (("hình sự", "hình sự"), ("dân sự", "dân sự"), ("hành chính", "hành chính"), ("kinh doanh", "kinh doanh thương mại"), ("thương mại", "kinh doanh thương mại"), ("lao động", "lao động"), ("hôn nhân", "hôn nhân & gia đình"), ("nuôi con nuôi", "hôn nhân & gia đình"))
FACTS, REASON = r"NỘI\s*DUNG\s*VỤ\s*ÁN", r"NHẬN\s*ĐỊNH"
NUMBER = r"(\d+/\d{4}/AL)\b"
# fixed values: a precedent's line of keywords, its section on the law and what ends it
KEYWORDS, QUOTED = r"(?iu)T[ừu]\s*kh[óo]a\s*c[ủu]a\s*[áa]n\s*l[ệe]\s*:?(.+)", "[\"“”']([^\"“”']{2,80})[\"“”']"
LAW_SECTION = r"(?iu)Quy\s*định\s*c[ủu]a\s*ph[áa]p\s*lu[ậa]t\s*li[êe]n\s*quan[^:]*:?"
LAW_SECTION_END = r"T[ừu]\s*kh[óo]a|N[Ộộ]I\s*DUNG|NH[Ậậ]N\s*[Đđ]|\n\s*\n"
# fixed values: an article with the law it is of, what a citation that was applied looks like
PAIR = r"(?iu)Điều\s+(\d+)[^;.\n]{0,80}?((?:Bộ\s*luật|Luật|Nghị\s*định|Thông\s*tư|Nghị\s*quyết|Pháp\s*lệnh|Hiến\s*pháp)[^;,.\n(]{0,70})"
APPLIED = r"(?iu)(?:điểm\s+[\p{L}\p{N}_]+\s+)?(?:khoản\s+\d+\s+)?Điều\s+\d+"
# fixed values: how useless answers and preambles begin
USELESS = ("Xin chào! Tôi là", "trợ lý tư vấn pháp luật Việt Nam", "Báo cáo kiểm tra")
PREAMBLES = ("bạn ", "dưới đây", "tóm tắt", "yêu cầu", "tôi hiểu", "tôi sẽ", "như sau", "sự việc")
NO_PENALTY = "(không rõ mức hình phạt)"


def kind_of(text: Column) -> Column:
    low, out = F.lower(text), F.lit("")
    for marker, name in reversed(KINDS):
        out = F.when(F.contains(low, F.lit(marker)), name).otherwise(out)
    return out


def keywords(text: Column) -> Column:
    """Crimes named in a precedent's line of keywords: the quoted ones, else up to six parts between semicolons."""
    line = F.split(F.regexp_extract(text, KEYWORDS, 1), "\n")[0]
    quoted = F.transform(F.regexp_extract_all(line, F.lit(QUOTED), F.lit(1)), lambda x: F.trim(x))
    parts = F.filter(F.transform(F.split(line, ";"), lambda p: F.btrim(p, F.lit(" .\t"))), lambda p: (F.length(p) > 2) & (F.length(p) < 80))
    return F.when(F.size(quoted) > 0, quoted).otherwise(F.slice(parts, 1, 6))


def main_articles(text: Column, title: Column) -> Column:
    """Articles of a precedent's section on the law: from its 600 characters up to the next heading, at most 8; else the title's."""
    rest = F.substring(F.regexp_extract(text, f"(?s){LAW_SECTION}(.*)$", 1), 1, 600)
    own = T.article_refs(F.split(rest, LAW_SECTION_END)[0])
    return F.when(F.size(own) > 0, F.slice(own, 1, 8)).otherwise(T.article_refs(title))


def precedent(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Precedent records of texts that carry a precedent's number; other texts have none."""
    t = F.col(text)
    number = F.regexp_extract(t, NUMBER, 1)
    return docs.where(number != "").select(key, number.alias("case_number"), kind_of(t).alias("case_type"), keywords(t).alias("crimes"), T.article_refs(t).alias("articles"), T.between(t, FACTS, REASON, 1200, 300).alias("facts_summary"), F.concat(F.lit("Án lệ số "), number).alias("title"))


def first_texts(spans: DataFrame, key: str, most: int = 12) -> DataFrame:
    """key, label, texts: the first `most` different texts that aren't blank of each label, by place."""
    own = spans.withColumn("t_", F.trim("text")).where("t_ <> ''")
    seen = own.groupBy(key, "label", "t_").agg(F.min("start").alias("at_"))
    ranked = seen.withColumn("rn_", F.row_number().over(Window.partitionBy(key, "label").orderBy("at_"))).where(F.col("rn_") <= most)
    return ranked.groupBy(key, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn_", "t_"))), lambda x: x["t_"]).alias("texts"))


def pronounced_penalty(penalties: Column) -> Column:
    """Of the first five the one with its number in words, else the first."""
    five = F.slice(penalties, 1, 5)
    return F.coalesce(F.try_element_at(F.filter(five, lambda p: p.rlike(r"\d+\s*\([^)\d]+\)")), F.lit(1)), F.try_element_at(five, F.lit(1)), F.lit(NO_PENALTY))


def offence_basis(bases: Column) -> Column:
    """Of the first four the one of the penal code itself, else the first."""
    four = F.slice(bases, 1, 4)
    penal = F.filter(four, lambda b: F.contains(F.lower(b), F.lit("hình sự")) & ~F.contains(F.lower(b), F.lit("tố tụng")))
    return F.coalesce(F.try_element_at(penal, F.lit(1)), F.try_element_at(four, F.lit(1)), F.lit(""))


def applied_citations(basis: Column) -> Column:
    found = F.regexp_extract_all(basis, F.lit(APPLIED), F.lit(0))
    return F.array_join(F.slice(F.array_distinct(F.transform(found, lambda c: F.regexp_replace(c, r"\s+", " "))), 1, 4), "; ")


def pairs(spans: DataFrame, key: str, most: int = 8) -> DataFrame:
    """key, ord, article, law: pairs of article and law in LEGAL_BASIS and ARTICLE spans; an article without a law gets the
    document's first LAW_NAME, where it isn't paired yet. The first `most`, each article and law once."""
    base = spans.where(F.col("label").isin("LEGAL_BASIS", "ARTICLE")).select(key, F.when(F.col("label") == "LEGAL_BASIS", 0).otherwise(1).alias("o1"), F.col("start").alias("o2"), "text")
    named = base.select(key, F.lit(0).alias("o0"), "o1", "o2", F.posexplode(F.regexp_extract_all("text", F.lit(PAIR), F.lit(0))).alias("o3", "m")).select(key, "o0", "o1", "o2", "o3", F.regexp_extract("m", PAIR, 1).cast("int").alias("article"), F.btrim(F.regexp_extract("m", PAIR, 2), F.lit(" ,;.")).alias("law"))
    default = spans.where("label = 'LAW_NAME' AND trim(text) <> ''").groupBy(key).agg(F.min_by(F.trim("text"), "start").alias("law"))
    bare = base.select(key, F.lit(1).alias("o0"), "o1", "o2", F.posexplode(F.regexp_extract_all("text", F.lit(r"Điều\s+(\d+)"), F.lit(1))).alias("o3", "a")).withColumn("article", F.col("a").cast("int")).drop("a")
    bare = bare.join(named.select(key, "article").distinct(), [key, "article"], "left_anti").join(default, key).select(*named.columns)
    every = named.unionByName(bare).withColumn("k_", T.law_key(F.col("law")))
    order = ["o0", "o1", "o2", "o3"]
    once = every.withColumn("rn_", F.row_number().over(Window.partitionBy(key, "article", "k_").orderBy(*order))).where("rn_ = 1")
    return once.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("ord") <= most).select(key, "ord", "article", "law")


def checked_pairs(pairs_: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """pairs with status found where a hit (article as `Điều N`, title) of that article has the law in its title."""
    h = hits.select(F.regexp_extract("article", r"^Điều (\d+)$", 1).try_cast("int").alias("article"), "title").where("article IS NOT NULL").groupBy("article").agg(F.collect_set("title").alias("titles"))
    x = pairs_.join(h, "article", "left")
    found = F.exists(F.coalesce("titles", F.array().cast("array<string>")), lambda t: T.law_in_title(F.col("law"), t))
    return x.select(key, "ord", "article", "law", F.when(found, "found").otherwise("not_found").alias("status"))


def retrieval_query(turns: DataFrame, key: str) -> DataFrame:
    """key, query, history: the last user turn that isn't blank before the question, with the question; the last six turns."""
    w = Window.partitionBy(key).orderBy(F.desc("turn"))
    last = turns.withColumn("rn_", F.row_number().over(w))
    q = last.where("rn_ = 1").select(key, F.trim("text").alias("question"))
    before = last.where("rn_ > 1 AND role = 'user' AND trim(text) <> ''").groupBy(key).agg(F.max_by(F.trim("text"), "turn").alias("before"))
    six = last.where("rn_ BETWEEN 2 AND 7").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("history"))
    return q.join(before, key, "left").join(six, key, "left").select(key, F.concat_ws(" ", "before", "question").alias("query"), "history")


def useless(answer: Column) -> Column:
    """Whether an answer is a greeting or a form instead of an analysis."""
    head = F.substring(answer, 1, 120)
    return F.exists(F.array(*map(F.lit, USELESS)), lambda m: F.contains(head, m))


def without_preamble(answer: Column) -> Column:
    """An answer without the sentences it begins with that only announce it."""
    parts = F.split(F.trim(answer), r"(?<=[.:])\s+")
    lead = lambda p: F.exists(F.array(*map(F.lit, PREAMBLES)), lambda m: F.contains(F.lower(p), m))
    keep = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((F.size(acc) == 0) & lead(p), acc).otherwise(F.array_append(acc, p)))
    return F.coalesce(F.nullif(F.trim(F.array_join(keep, " ")), F.lit("")), F.trim(answer))


def opening(facts: Column, most: int = 320, least: int = 140) -> Column:
    """The first sentences of the facts, after `như sau`, cut at the last sentence end from `least` characters on."""
    s = F.substring(F.regexp_replace(F.trim(F.regexp_replace(facts, r"(?isu)^.*?như sau\s*:?", "")), r"\s{2,}", " "), 1, most)
    cut = F.regexp_extract(s, rf"(?s)^(.{{{least},}}\.) ", 1)
    return F.trim(F.when(cut != "", cut).otherwise(s))


def facts_section(text: Column, most: int = 4000, skip: int = 400) -> Column:
    """What a text tells between the headings of facts and reasons; without the second the `most` characters after the first,
    without both those from `skip` up to `most`; blanks, colons and line ends at its ends go."""
    a, head = F.regexp_instr(text, F.lit(f"(?iu){FACTS}")), F.length(F.regexp_extract(text, f"(?iu){FACTS}", 0))
    b = F.regexp_instr(text, F.lit(f"(?iu){REASON}"))
    after = a + head
    seg = F.when((a > 0) & (b > after), F.substring(text, after, b - after)).when(a > 0, F.substring(text, after, F.lit(most))).otherwise(F.substring(text, F.lit(skip + 1), F.lit(most - skip)))
    return F.substring(F.regexp_replace(seg, r"^[ :\n\t]+|[ :\n\t]+$", ""), 1, most)


def metadata_record(number: Column, title: Column, text: Column) -> Column:
    """A precedent's record out of its number and title, richer where its text is there: the title leads the facts."""
    own = F.coalesce(F.nullif(text, F.lit("")), title)
    facts = F.when(F.coalesce(text, F.lit("")) != "", T.between(text, FACTS, REASON, 1200, 300)).otherwise("")
    joined = F.regexp_replace(F.concat_ws(". ", F.nullif(title, F.lit("")), F.nullif(facts, F.lit(""))), r"^[. ]+|[. ]+$", "")
    return F.struct(number.alias("case_number"), kind_of(own).alias("case_type"), main_articles(F.coalesce(text, F.lit("")), title).alias("articles"), F.coalesce(F.nullif(joined, F.lit("")), title).alias("facts_summary"), own.alias("full_text"))


def case_record(docs: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """A case's record out of its spans (key, label, start, text) and its text: court, crimes, articles, penalties, facts."""
    none = F.array().cast("array<string>")
    labels = ["COURT", "CRIME", "ARTICLE", "LEGAL_BASIS", "PENALTY"]
    by = first_texts(spans.where(F.col("label").isin(*labels)), key, 20).groupBy(key).pivot("label", labels).agg(F.first("texts"))
    x = docs.select(key, F.col(text).alias("text_")).join(by, key, "left").na.fill({})
    first = lambda c, n: F.slice(F.coalesce(c, none), 1, n)
    cited = F.concat_ws(" ", F.array_join(first("ARTICLE", 20), " "), F.array_join(first("LEGAL_BASIS", 8), " "))
    return x.select(
        key, F.coalesce(F.try_element_at(F.coalesce("COURT", none), F.lit(1)), F.lit("")).alias("court"), first("CRIME", 8).alias("crimes"), T.article_refs(cited).alias("articles"), first("PENALTY", 6).alias("penalties"),
        F.coalesce(T.between(F.col("text_"), FACTS, REASON, 1200, 300), F.lit("")).alias("facts_summary"), F.coalesce("text_", F.lit("")).alias("full_text"),
    )


def fact_lines(spans: DataFrame, key: str, labels: list[tuple[str, str]], most: int = 8) -> DataFrame:
    """key, facts: a line per label with its first different texts, labels in the order given (label, shown name), others after
    them by name."""
    names = F.create_map(*[F.lit(x) for kv in labels for x in kv])
    rank = F.create_map(*[F.lit(x) for i, (label, _) in enumerate(labels) for x in (label, i)])
    own = first_texts(spans, key, most)
    line = F.concat(F.lit("- "), F.coalesce(names[F.col("label")], F.col("label")), F.lit(": "), F.array_join("texts", "; "))
    rows = own.select(key, F.struct(F.coalesce(rank[F.col("label")], F.lit(len(labels))).alias("r"), "label", line.alias("line")).alias("x"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("facts"))


def request_body(content: Column, model: str, search: Column, other_model: Column) -> Column:
    """The body of a request for an answer as JSON; what isn't given is left out."""
    message = F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.to_json(F.struct(F.lit(model).alias("model"), message.alias("messages"), F.lit(False).alias("stream"), F.lit(0.2).alias("temperature"), F.lit(True).alias("skip_router"), blank(search).alias("search_query"), blank(other_model).alias("llm_model")))


def corpus_counts(checked: DataFrame, key: str) -> DataFrame:
    """key, status, checked, found, not_found of checked pairs (status found, not_found or error): skipped if all are errors."""
    n = lambda s: F.count_if(F.col("status") == s)
    g = checked.groupBy(key).agg(F.count("*").alias("n"), n("error").alias("e"), n("found").alias("f"), n("not_found").alias("m"))
    bad = F.col("n") == F.col("e")
    zero = lambda c: F.when(bad, 0).otherwise(c).cast("bigint")
    return g.select(key, F.when(bad, "skipped").otherwise("ok").alias("status"), zero(F.col("n") - F.col("e")).alias("checked"), zero(F.col("f")).alias("found"), zero(F.col("m")).alias("not_found"))
