"""Citations out of free text and out of spans, and the search for where a misplaced one belongs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicrux.functions.spans import let, matches
from lexicrux.operators.law import law_tag

# fixed values: the parts of a citation and the names of laws, procedure before substance
POINT, CLAUSE, ARTICLE = r"đi[eể]m\s+[a-zđ](?:\s*,\s*[a-zđ])*", r"kho[aả]n\s*0*\d{1,3}", r"đi[eề]u\s*0*\d{1,3}"
LAWS = r"tố\s*tụng\s*hình\s*sự|tố\s*tụng\s*dân\s*sự|\bbộ\s*luật\s*hình\s*sự\b|\bbộ\s*luật\s*dân\s*sự\b|nghị\s*quyết|thông\s*tư|nghị\s*định|luật\s*thi\s*hành\s*án|luật\s*[\p{L}\p{N}_]|hiến\s*pháp"
# how far, in characters and in spans, a part may stand from its article
NEAR, BACK, AHEAD, CHAIN = 60, 6, 3, 80


def _law_starts(text: Column) -> Column:
    """Places of law names. `bộ luật tố tụng …` is one name, found from its `tố tụng`; `luật …` inside a code's name is none."""
    own = matches(text, "(?i)" + LAWS)
    inside = matches(text, r"(?i)bộ\s*luật\s*(?:tố\s*tụng\s*)?(?:hình|dân)\s*sự")
    lead = F.transform(own, lambda s: s["start"])
    named = F.transform(inside, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b")))
    return let(named, lambda ns: F.array_sort(F.array_distinct(F.concat(F.filter(lead, lambda x: ~F.exists(ns, lambda n: (x >= n["a"]) & (x < n["b"]))), F.transform(ns, lambda n: n["a"])))))


def parsed(text: Column) -> Column:
    """Citations of a text: points and clauses bind forward to the next article, the nearest of each; the law is the first
    named before the next article, else the last named in the text; a point of several letters gives a citation each."""
    whole = F.length(text)

    def walk(k: Column) -> Column:
        def one(a: Column, i: Column) -> Column:
            prior, following = F.when(i > 0, F.get(k["articles"], i - 1)["start"]).otherwise(-1), F.coalesce(F.get(k["articles"], i + 1)["start"], whole)
            last = lambda xs: F.try_element_at(F.filter(xs, lambda s: (s["start"] > prior) & (s["start"] < a["start"])), F.lit(-1))["text"]
            law_at = F.coalesce(F.array_min(F.filter(k["laws"], lambda x: (x > a["start"]) & (x < following))), F.array_max(k["laws"]))
            return F.struct(
                F.regexp_extract(a["text"], r"(\d{1,3})$", 1).cast("int").alias("so_dieu"),
                F.regexp_extract(last(k["clauses"]), r"(\d{1,3})$", 1).try_cast("int").alias("so_khoan"),
                F.split(F.regexp_replace(F.lower(last(k["points"])), r"(?u)^đi[eể]m\s+|\s", ""), ",").alias("letters"),
                F.substring(text, law_at + 1, F.lit(40)).alias("law_text"),
                i.cast("int").alias("ord"),
            )

        return F.transform(k["articles"], one)

    rx = lambda p: matches(text, "(?i)" + p)
    known = F.struct(rx(ARTICLE).alias("articles"), rx(CLAUSE).alias("clauses"), rx(POINT).alias("points"), _law_starts(text).alias("laws"))
    return let(known, walk)


def citations(fields: DataFrame, text: str) -> DataFrame:
    """fields with a row per citation: so_dieu, so_khoan, diem, law, law_text, ord; fields without an article have none."""
    own = fields.withColumn("c_", F.explode(parsed(F.col(text))))
    own = own.withColumn("diem", F.explode_outer("c_.letters"))
    return own.select(*fields.columns, "c_.so_dieu", "c_.so_khoan", "diem", law_tag(F.col("c_.law_text")).alias("law"), "c_.law_text", "c_.ord")


def reconstructed(spans: DataFrame, key: str) -> DataFrame:
    """Citations out of separate ARTICLE, CLAUSE, POINT and LAW_NAME spans (key, label, start, text): the nearest clause, point
    and law among the BACK spans before within NEAR characters, else a law among the AHEAD spans after; a new chain begins
    where articles stand more than CHAIN characters apart."""
    w = Window.partitionBy(key).orderBy("start")
    s = spans.where(F.col("label").isin("ARTICLE", "CLAUSE", "POINT", "LAW_NAME"))
    here = F.struct("start", "label", "text")
    s = s.withColumn("before", F.collect_list(here).over(w.rowsBetween(-BACK, -1))).withColumn("after", F.collect_list(here).over(w.rowsBetween(1, AHEAD)))
    a = s.where("label = 'ARTICLE'").withColumn("so_dieu", F.regexp_extract("text", r"(?iu)đi[eề]u\s*0*(\d{1,3})", 1).try_cast("int")).where("so_dieu IS NOT NULL")
    near = F.filter("before", lambda x: F.col("start") - x["start"] <= NEAR)
    ahead = F.filter("after", lambda x: x["start"] - F.col("start") <= NEAR)
    last = lambda label: F.try_element_at(F.filter(near, lambda x: x["label"] == label), F.lit(-1))["text"]
    law = F.coalesce(last("LAW_NAME"), F.try_element_at(F.filter(ahead, lambda x: x["label"] == "LAW_NAME"), F.lit(1))["text"])
    gap = F.col("start") - F.lag("start").over(w)
    return a.select(
        key, "start", F.sum(F.when(gap.isNull() | (gap > CHAIN), 1).otherwise(0)).over(w).cast("int").alias("chain"), "so_dieu",
        F.regexp_extract(last("CLAUSE"), r"(?iu)kho[aả]n\s*0*(\d{1,3})", 1).try_cast("int").alias("so_khoan"),
        F.nullif(F.lower(F.regexp_extract(last("POINT"), r"(?iu)đi[eể]m\s+([a-zđ])", 1)), F.lit("")).alias("diem"),
        law_tag(law).alias("law"), law.alias("law_text"),
    )


def first_of_each(cits: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per article, clause, point and law of a key: the one that comes first, chain and wording aside."""
    w = Window.partitionBy(key, "so_dieu", "so_khoan", "diem", "law").orderBy(*order)
    return cits.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def reattached(missing: DataFrame, cits: DataFrame, law: DataFrame, key: str) -> DataFrame:
    """Where citations that the law doesn't hold may belong (key, chain, law_key, so_dieu, so_khoan, diem): in this order
    another clause of the same article named in the chain, any clause of it, another article of the chain, another of the
    document; the first that the law (law_key, so_dieu, so_khoan, diem) holds."""
    m = missing.withColumn("mid_", F.xxhash64(key, "chain", "law_key", "so_dieu", "so_khoan", "diem"))
    same = [key, "chain", "law_key"]
    held = law.select("law_key", F.col("so_dieu").alias("d2"), F.col("so_khoan").alias("k2"), F.col("diem").alias("p2"))
    fits = lambda df: df.join(held, (df["law_key"] == held["law_key"]) & (df["d2_"] == held["d2"]) & (df["k2_"] == held["k2"]) & df["diem"].eqNullSafe(held["p2"])).select("mid_", "way", "d2", "k2")
    named = cits.select(*same, F.col("so_dieu").alias("d2_"), F.col("so_khoan").alias("k2_")).distinct()
    chain = m.join(named, same).where("k2_ IS NOT NULL")
    one = fits(chain.where("d2_ = so_dieu AND NOT k2_ <=> so_khoan").withColumn("way", F.lit(1)))
    any_clause = m.join(held.withColumnsRenamed({"law_key": "lk"}), (F.col("lk") == F.col("law_key")) & (F.col("d2") == F.col("so_dieu")) & F.col("diem").eqNullSafe(F.col("p2"))).select("mid_", F.lit(2).alias("way"), "d2", "k2")
    three = fits(chain.where("d2_ <> so_dieu").withColumn("way", F.lit(3)))
    four = fits(m.join(named.drop("chain").distinct(), [key, "law_key"]).where("d2_ <> so_dieu AND k2_ IS NOT NULL").withColumn("way", F.lit(4)))
    every = one.unionByName(any_clause).unionByName(three).unionByName(four)
    best = every.groupBy("mid_").agg(F.min(F.struct("way", "d2", "k2")).alias("b"))
    return m.join(best, "mid_").select(*missing.columns, F.col("b.way").alias("way"), F.col("b.d2").alias("to_dieu"), F.col("b.k2").alias("to_khoan"))


def collected(spans: DataFrame, key: str) -> DataFrame:
    """All citations of a document's spans (key, label, start, text): those of its LEGAL_BASIS spans, a chain each, and those put
    together from separate spans, whose chains go on from there; each article, clause, point and law once, the first."""
    base = spans.where("label = 'LEGAL_BASIS'").withColumn("chain", F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1)
    own = citations(base.select(key, "chain", "start", "text"), "text").select(key, "start", "chain", "so_dieu", "so_khoan", "diem", "law", "law_text", "ord")
    many = base.groupBy(key).agg(F.count("*").alias("n_"))
    rest = reconstructed(spans, key).join(many, key, "left").withColumn("chain", F.col("chain") + F.coalesce("n_", F.lit(0)) - 1)
    every = own.unionByName(rest.select(key, "start", "chain", "so_dieu", "so_khoan", "diem", "law", "law_text", F.lit(0).alias("ord")))
    return first_of_each(every, key, ["chain", "start", "ord"])


def summary(verified: DataFrame, key: str) -> DataFrame:
    """Counters of a document's citations (so_dieu, law_key, level, in_force, penalty, charge, whichever are known): how many,
    held by the statutes, missing by level, out of scope, not yet or no longer in force, outside their frame, off their charge."""
    has = verified.columns
    own = F.col("law_key").isNotNull()
    one = lambda name, cond: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    return verified.groupBy(key).agg(
        F.count("*").alias("total"), one("valid", own & (F.col("level") == "found")), one("not_found", own & (F.col("level") != "found")), one("out_of_scope", ~own),
        *(one(x, own & (F.col("level") == x)) for x in ("no_dieu", "no_khoan", "no_diem")),
        one("not_in_force", ~F.col("in_force") if "in_force" in has else F.lit(False)), one("out_of_frame", F.col("penalty") == "out_of_frame" if "penalty" in has else F.lit(False)),
        one("charge_matched", F.col("charge") == "true" if "charge" in has else F.lit(False)),
    )
