"""Statutes: text into articles, clauses and points, penalty frames, validity, and checks of what a judgment cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexicrux.functions import text as T
from lexicrux.functions.spans import let

# fixed values: the registry of laws
REGISTRY = (
    ("BLHS2015", "Bộ luật Hình sự", "100/2015/QH13", 426, "2018-01-01"),
    ("BLTTHS2015", "Bộ luật Tố tụng hình sự", "101/2015/QH13", 510, "2018-01-01"),
    ("BLDS2015", "Bộ luật Dân sự", "91/2015/QH13", 689, "2017-01-01"),
    ("NQ326_2016", "Nghị quyết về án phí, lệ phí Tòa án", "326/2016/UBTVQH14", 48, "2017-01-01"),
)
TAG_TO_KEY = {"BLHS": "BLHS2015", "BLTTHS": "BLTTHS2015", "BLDS": "BLDS2015"}


def registry(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(*r, None) for r in REGISTRY], "law_key STRING, name STRING, number STRING, articles INT, effective_from STRING, effective_to STRING")
    return rows.withColumns({c: F.to_date(c) for c in ("effective_from", "effective_to")})


# fixed values: other spellings of a law's key, once blanks are gone, hyphens are underscores and letters capitals
ALIASES = TAG_TO_KEY | {"NQ326": "NQ326_2016", "NQ326_2016_UBTVQH14": "NQ326_2016"}
DEFAULT_LAW = "BLHS2015"
#: Articles of the penal code that define offences, where no part is named.
OFFENCES, OFFENCE_PART = (108, 425), "CÁC TỘI PHẠM"


def canonical_law(c: Column) -> Column:
    """The registry's key for any spelling of it; unknown, blank and null ones are the default law."""
    known = {k: k for k, *_ in REGISTRY} | ALIASES
    key = F.replace(F.replace(F.upper(F.trim(c)), F.lit(" "), F.lit("")), F.lit("-"), F.lit("_"))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])[key], F.lit(DEFAULT_LAW))


def law_label(key: Column) -> Column:
    """Name, year and number of a law; a key that isn't registered stands for itself."""
    names = {k: f"{name} {number.split('/')[1]} ({number})" for k, name, number, *_ in REGISTRY}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key], key)


def is_offence(law_key: Column, article: Column, part: Column) -> Column:
    """Whether an article defines an offence: of the penal code only, by its part's name, else by its number."""
    named = F.coalesce(F.contains(F.upper(part), F.lit(OFFENCE_PART)), F.lit(False))
    return F.coalesce((law_key == DEFAULT_LAW) & (named | article.between(*OFFENCES)), F.lit(False))


def law_tag(c: Column) -> Column:
    """BLHS, BLTTHS, BLDS, OTHER or UNKNOWN; a code with a first year other than 2015 is OTHER."""
    year = F.regexp_extract(c, r"(?iu)năm\s*((?:19|20)\d{2})", 1)
    held = year.isin("", "2015")
    has = lambda rx: c.rlike("(?iu)" + rx)
    return (
        F.when(c.isNull() | (c == ""), "UNKNOWN")
        .when(has(r"tố\s*tụng\s*hình\s*sự"), F.when(held, "BLTTHS").otherwise("OTHER"))
        .when(has(r"tố\s*tụng\s*dân\s*sự"), "OTHER")
        .when(has(r"(?U)\bbộ\s*luật\s*hình\s*sự\b"), F.when(held, "BLHS").otherwise("OTHER"))
        .when(has(r"(?U)\bbộ\s*luật\s*dân\s*sự\b"), F.when(held, "BLDS").otherwise("OTHER"))
        .when(has(r"nghị\s*quyết|thông\s*tư|nghị\s*định|luật\s*[\p{L}\p{N}_]|hiến\s*pháp"), "OTHER")
        .otherwise("UNKNOWN")
    )


def statute_lines(articles: DataFrame) -> DataFrame:
    """Lines of article texts (law_key, so_dieu, text) with the clause and point they belong to.

    A line `N. ` opens a clause, a line `x) ` in a clause a point; what follows belongs to the last opened; an article
    without numbered clauses has its body as clause 1, a preamble before numbered clauses is left out."""
    key = ["law_key", "so_dieu"]
    lines = articles.select(*key, F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    lines = lines.withColumn("line", F.rtrim("line")).where(~((F.col("pos") == 0) & F.col("line").rlike(r"^Điều\s+\d+\.")))
    w = Window.partitionBy(*key).orderBy("pos")
    opens = F.col("line").rlike(r"^\d{1,2}\.\s+")
    lines = lines.withColumn("clause_no", F.sum(opens.cast("int")).over(w)).withColumn("numbered", F.max(opens).over(Window.partitionBy(*key)))
    lines = lines.where("clause_no > 0 OR NOT numbered").withColumn("clause_no", F.greatest("clause_no", F.lit(1)))
    wc = Window.partitionBy(*key, "clause_no").orderBy("pos")
    point = F.col("numbered") & F.col("line").rlike(r"^[a-zđ]\)\s+")
    lines = lines.withColumn("point_no", F.sum(point.cast("int")).over(wc))
    number = F.when(F.col("numbered"), F.regexp_extract(F.first("line").over(wc), r"^(\d{1,2})\.", 1).cast("int")).otherwise(1)
    return lines.withColumn("so_khoan", number).withColumn("body", F.when(F.col("numbered") & (F.row_number().over(wc) == 1), F.regexp_replace("line", r"^\d{1,2}\.\s+", "")).otherwise(F.trim("line")))


def clauses(articles: DataFrame) -> DataFrame:
    """law_key, so_dieu, so_khoan, noi_dung, points (letter and text); of a clause number given twice the first."""
    key = ["law_key", "so_dieu", "clause_no"]
    lines = statute_lines(articles)
    body = lines.groupBy(*key, "so_khoan").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "\n").alias("noi_dung"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), " ")
    points = lines.where("point_no > 0").groupBy(*key, "point_no").agg(text.alias("t"))
    points = points.select(*key, "point_no", F.substring("t", 1, 1).alias("ky_hieu"), F.regexp_replace("t", r"^[a-zđ]\)\s+", "").alias("noi_dung"))
    nested = points.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("point_no", "ky_hieu", "noi_dung"))), lambda x: F.struct(x["ky_hieu"].alias("ky_hieu"), x["noi_dung"].alias("noi_dung"))).alias("points"))
    first = F.row_number().over(Window.partitionBy("law_key", "so_dieu", "so_khoan").orderBy("clause_no"))
    out = body.join(nested, key, "left").withColumn("r", first).where("r = 1")
    return out.select("law_key", "so_dieu", "so_khoan", "noi_dung", F.coalesce("points", F.array().cast("array<struct<ky_hieu:string,noi_dung:string>>")).alias("points"))


# fixed values: how the frames of a clause are worded
_N = r"(\d[\d.,]*)"
RANGE, FIXED = rf"(?iu)phạt tù\s+từ\s+{_N}\s*(năm|tháng)\s+đến\s+{_N}\s*(năm|tháng)", rf"(?iu)phạt tù\s+{_N}\s*(năm|tháng)(?![\p{{L}}\p{{N}}_])(?!\s*đến)"
FINES, FINE = rf"(?iu)phạt tiền\s+từ\s+{_N}\s*đồng\s+đến\s+{_N}\s*đồng", rf"(?iu)phạt tiền\s+{_N}\s*đồng(?![\p{{L}}\p{{N}}_])(?!\s*đến)"
REFORM = rf"(?iu)cải tạo không giam giữ\s+đến\s+{_N}\s*(năm|tháng)"


def years(value: Column, unit: Column, digits: int = 4) -> Column:
    return F.when(F.lower(unit) == "tháng", F.round(value / 12, digits)).otherwise(value)


def penalty_frames(c: Column) -> Column:
    """Frames a clause allows, in the order prison ranges or the first fixed term, life, death, fine, reform, warning."""
    frame = "struct<kind:string,min:double,max:double,unit:string,raw:string>"
    one = lambda kind, lo, hi, unit, raw: F.struct(F.lit(kind).alias("kind"), lo.cast("double").alias("min"), hi.cast("double").alias("max"), (F.lit(unit) if unit else F.lit(None).cast("string")).alias("unit"), raw.alias("raw"))
    null = F.lit(None)
    rng, fix, fine, fine1, reform = RANGE, FIXED, FINES, FINE, REFORM
    ex = lambda rx, g, t=c: F.regexp_extract(t, rx, g)
    num = lambda x, money=False: T.number_of(x, F.lit(money))
    ranges = F.transform(F.regexp_extract_all(c, F.lit(rng), F.lit(0)), lambda m: one("tu_co_thoi_han", years(num(F.regexp_extract(m, rng, 1)), F.regexp_extract(m, rng, 2)), years(num(F.regexp_extract(m, rng, 3)), F.regexp_extract(m, rng, 4)), "nam", F.trim(m)))
    fixed = years(num(ex(fix, 1)), ex(fix, 2))
    rest = F.array(
        F.when(~c.rlike(rng) & c.rlike(fix), one("tu_co_thoi_han", fixed, fixed, "nam", F.trim(ex(fix, 0)))),
        F.when(c.rlike("(?iu)tù chung thân"), one("tu_chung_than", null, null, None, F.lit("tù chung thân"))),
        F.when(c.rlike("(?iu)tử hình"), one("tu_hinh", null, null, None, F.lit("tử hình"))),
        F.when(c.rlike(fine), one("phat_tien", num(ex(fine, 1), True), num(ex(fine, 2), True), "dong", F.trim(ex(fine, 0)))).when(c.rlike(fine1), one("phat_tien", num(ex(fine1, 1), True), num(ex(fine1, 1), True), "dong", F.trim(ex(fine1, 0)))),
        F.when(c.rlike(reform), one("cai_tao_khong_giam_giu", F.lit(0.0), years(num(ex(reform, 1)), ex(reform, 2)), "nam", F.trim(ex(reform, 0)))),
        F.when(c.rlike("(?iu)phạt cảnh cáo"), one("canh_cao", null, null, None, F.lit("phạt cảnh cáo"))),
    )
    return F.concat(ranges.cast(f"array<{frame}>"), F.filter(rest, lambda x: x.isNotNull()).cast(f"array<{frame}>"))


def pronounced(c: Column) -> Column:
    """kind and years of a pronounced penalty: death, life, or a prison term; null for anything else."""
    ym = r"(?iu)0*(\d{1,3})\s*năm(?:\s*(?:\(.*?\)\s*)?0*(\d{1,2})\s*tháng)?"
    mo = r"(?iu)0*(\d{1,2})\s*tháng"
    out = lambda kind, y: F.struct(F.lit(kind).alias("kind"), y.cast("double").alias("years"))
    extra = F.coalesce(F.regexp_extract(c, ym, 2).try_cast("int"), F.lit(0))
    return (
        F.when(c.rlike(r"(?iu)tử\s*hình"), out("tu_hinh", F.lit(None)))
        .when(c.rlike(r"(?iu)chung\s*thân"), out("tu_chung_than", F.lit(None)))
        .when(~F.contains(F.lower(c), F.lit("tù")), None)
        .when(c.rlike(ym), out("tu_co_thoi_han", F.round(F.regexp_extract(c, ym, 1).try_cast("int") + extra / 12.0, 3)))
        .when(c.rlike(mo), out("tu_co_thoi_han", F.round(F.regexp_extract(c, mo, 1).try_cast("int") / 12.0, 3)))
    )


# fixed values: how severe a kind is
SEVERITY = {"tu_co_thoi_han": 1, "tu_chung_than": 2, "tu_hinh": 3}


def sentencing(kind: Column, term: Column, frames: Column) -> Column:
    """within_frame, out_of_frame, note or uncertain: a pronounced penalty against a clause's frames."""

    def check(fs: Column) -> Column:
        kinds = F.transform(fs, lambda f: f["kind"])
        severe = F.coalesce(F.array_max(F.transform(kinds, _rank)), F.lit(0))
        prison = F.try_element_at(F.filter(fs, lambda f: (f["kind"] == "tu_co_thoi_han") & (f["unit"] == "nam")), F.lit(1))
        higher = F.arrays_overlap(kinds, F.array(F.lit("tu_chung_than"), F.lit("tu_hinh")))
        own = F.when(F.array_contains(kinds, kind), "within_frame").when(_rank(kind) > severe, "out_of_frame").otherwise("note")
        timed = (
            F.when(prison.isNull(), F.when(higher, "note").otherwise("uncertain"))
            .when(term.isNull() | (prison["min"].isNull() & prison["max"].isNull()), "uncertain")
            .when(prison["max"].isNotNull() & (term > prison["max"] + 1e-6) & ~higher, "out_of_frame")
            .when(prison["min"].isNotNull() & (term < prison["min"] - 1e-6), "note")
            .otherwise("within_frame")
        )
        return F.when(F.size(fs) <= 0, "uncertain").when(kind.isin("tu_hinh", "tu_chung_than"), own).otherwise(timed)

    return let(F.coalesce(frames, F.array()), check)


def _rank(kind: Column) -> Column:
    out = F.lit(0)
    for k, v in SEVERITY.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def severest(penalties: Column) -> Column:
    """Of pronounced penalties (texts) the most severe: kind and years, by kind, then by length; the first of equals."""
    own = F.filter(F.transform(penalties, lambda p, i: F.struct(pronounced(p).alias("p"), i.alias("i"))), lambda x: x["p"]["kind"].isNotNull())
    row = lambda x: F.struct(_rank(x["p"]["kind"]).alias("rank"), F.coalesce(x["p"]["years"], F.lit(0.0)).alias("y"), (-x["i"]).alias("i"), x["p"].alias("p"))
    return F.array_max(F.transform(own, row))["p"]


def statute_store(texts: DataFrame) -> dict[str, DataFrame]:
    """Tables of a statute store out of article texts (law_key, so_dieu, text, and phan, chuong, muc where known): articles,
    clauses, points and penalty_frames, under natural keys in place of running numbers."""
    where = [c if c in texts.columns else F.lit(None).cast("string").alias(c) for c in ("phan", "chuong", "muc")]
    title = F.nullif(F.trim(F.regexp_extract("text", r"^\s*Điều\s+\d+\.[^\S\n]*([^\n]*)", 1)), F.lit(""))
    articles = texts.select("law_key", "so_dieu", title.alias("tieu_de"), *where, F.col("text").alias("noi_dung"))
    articles = articles.withColumn("is_offense", is_offence(F.col("law_key"), F.col("so_dieu"), F.col("phan")))
    own = clauses(texts)
    points = own.select("law_key", "so_dieu", "so_khoan", F.explode("points").alias("p")).select("law_key", "so_dieu", "so_khoan", "p.ky_hieu", "p.noi_dung")
    frames = own.select("law_key", "so_dieu", "so_khoan", F.posexplode(penalty_frames(F.col("noi_dung"))).alias("ord", "f"))
    return {"articles": articles, "clauses": own.drop("points"), "points": points, "penalty_frames": frames.select("law_key", "so_dieu", "so_khoan", "ord", "f.*")}


def write_store(store: dict[str, DataFrame], path: str) -> None:
    """The store as parquet, a folder a table, clustered by law; what was there is replaced."""
    for name, table in store.items():
        table.write.mode("overwrite").partitionBy("law_key").parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("articles", "clauses", "points", "penalty_frames")}


def in_force(on: Column, start: Column, end: Column) -> Column:
    """True, False, or null where a needed date is missing."""
    return F.when(on.isNull() | start.isNull(), None).otherwise((on >= start) & (end.isNull() | (on <= end)))


def verify(citations: DataFrame, articles: DataFrame, clauses_: DataFrame, points: DataFrame) -> DataFrame:
    """citations (law_key, so_dieu, so_khoan, diem and others) with level: found, or the level that is missing.

    The statutes are a dimension; each level is one left join on its key, broadcast by Spark where small enough."""
    k = ["law_key", "so_dieu"]
    a = articles.select(*k).distinct().withColumn("has_dieu", F.lit(True))
    c = clauses_.select(*k, "so_khoan").distinct().withColumn("has_khoan", F.lit(True))
    p = points.select(*k, "so_khoan", F.col("ky_hieu").alias("diem")).distinct().withColumn("has_diem", F.lit(True))
    own = citations.join(a, k, "left").join(c, [*k, "so_khoan"], "left").join(p, [*k, "so_khoan", "diem"], "left")
    level = F.when(F.col("has_dieu").isNull(), "no_dieu").when(F.col("so_khoan").isNotNull() & F.col("has_khoan").isNull(), "no_khoan").when(F.col("diem").isNotNull() & F.col("has_diem").isNull(), "no_diem").otherwise("found")
    return own.withColumn("level", level).drop("has_dieu", "has_khoan", "has_diem")


def charge_match(crime: Column, title: Column) -> Column:
    """true or uncertain: a crime's name against an article's title, folded (đ kept), by containment or 0.7 of its words."""
    c = F.trim(F.lower(T.folded(crime, keep_d=True)))
    t = F.regexp_replace(F.trim(F.lower(T.folded(title, keep_d=True))), r"^toi\s+", "")
    cw, tw = F.array_distinct(F.split(c, r"\s+")), F.array_distinct(F.split(t, r"\s+"))
    near = F.size(F.array_intersect(cw, tw)) / F.size(cw) >= 0.7
    return F.when((F.coalesce(crime, F.lit("")) == "") | (F.coalesce(title, F.lit("")) == "") | (F.length(c) < 4), "uncertain").when(F.contains(t, c) | F.contains(c, t) | near, "true").otherwise("uncertain")


def charge_of_any(crimes: Column, titles: Column) -> Column:
    """The best of all crimes against all titles: true if one fits, else uncertain."""
    fits = F.exists(crimes, lambda c: F.exists(titles, lambda t: charge_match(c, t) == "true"))
    return F.when(F.coalesce(fits, F.lit(False)), "true").otherwise("uncertain")
