"""Whether a judgment exists: candidates of the same core number, scored by number, court and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicrux.functions import text as T

FOUND = 0.85


def similarity(a: Column, b: Column) -> Column:
    """Shared words of two normalised names over all their words."""
    x, y = (F.array_distinct(F.filter(F.split(c, " "), lambda w: w != "")) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def _ready(df: DataFrame, p: str) -> DataFrame:
    """p with its key, court, date and core number; numbers that are empty have no row."""
    own = df.select(F.col(p), T.case_key(F.col("case_number")).alias(f"{p}_key"), T.court_key(F.col("court")).alias(f"{p}_court"), F.col("court").alias(f"{p}_raw"), T.iso_date(F.col("date")).alias(f"{p}_date"), F.col("date").alias(f"{p}_rawdate"))
    return own.where(F.col(f"{p}_key") != "").withColumn("core", T.core_number(F.col(f"{p}_key")))


def scored(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """queries (q, case_number, court, date) joined with candidates (c, case_number, court, date) on the core number.

    score = 0.6 for the same number, 0.36 for the same core, + 0.25 court + 0.15 date, halves where the query has none."""
    x = _ready(queries, "q").join(_ready(candidates, "c"), "core")
    court = F.when(F.coalesce("q_raw", F.lit("")) == "", 0.5).otherwise(similarity(F.col("q_court"), F.col("c_court")))
    date = F.when(F.coalesce("q_rawdate", F.lit("")) == "", 0.5).when((F.col("q_date") != "") & (F.col("q_date") == F.col("c_date")), 1.0).otherwise(0.0)
    exact = F.col("q_key") == F.col("c_key")
    score = F.when(exact, 0.6).otherwise(0.36) + 0.25 * court + 0.15 * date
    return x.select("q", "c", F.round(F.least(score, F.lit(1.0)), 3).alias("score"), exact.alias("case_match"))


def reports(queries: DataFrame, candidates: DataFrame, most: int = 10) -> DataFrame:
    """Per query the status by its best candidate (found: same number and FOUND or more; found_partial: any other) and the
    first `most` candidates; queries without a candidate are not_found."""
    s = scored(queries, candidates).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("r") <= most)
    best = s.groupBy("q").agg(F.max_by("score", -F.col("r")).alias("score"), F.max_by("case_match", -F.col("r")).alias("case_match"), F.count("*").alias("candidates"))
    status = F.when(F.col("score").isNull(), "not_found").when(F.col("case_match") & (F.col("score") >= FOUND), "found").otherwise("found_partial")
    return queries.select("q").join(best, "q", "left").select("q", status.alias("status"), "score", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def best_reports(queries: DataFrame, candidates: DataFrame, most: int = 10) -> DataFrame:
    """The rows of reports() without its pairs: a candidate's score is its number's share, its court's and its date's, so the
    best is among those of the same date, those of the same number, and the best court of the same core. Courts and numbers are
    joined once each; what a group takes for less than its score is outdone by that candidate in another group."""
    q = _ready(queries, "q").withColumn("q_blank", F.coalesce("q_raw", F.lit("")) == "").withColumn("half", F.coalesce("q_rawdate", F.lit("")) == "")
    c = _ready(candidates, "c")
    court = F.when(F.col("q_blank"), 0.5).otherwise(similarity(F.col("q_court"), F.col("c_court")))

    def top(pairs: DataFrame, by: list[str], number, date) -> DataFrame:
        score = F.round(F.least(number + 0.25 * court + 0.15 * date, F.lit(1.0)), 3)
        return pairs.groupBy(*by).agg(F.max(F.struct(score.alias("score"), (-F.col("c")).alias("c"), (F.col("q_key") == F.col("c_key") if "c_key" in pairs.columns else F.lit(False)).alias("case_match"))).alias("b"))

    half = F.when(F.col("half"), 0.5).otherwise(0.0)
    same = F.when(F.col("q_key") == F.col("c_key"), 0.6).otherwise(0.36)
    dated = top(q.where("NOT half AND q_date <> ''").join(c.select("core", F.col("c_date").alias("q_date"), "c", "c_key", "c_court"), ["core", "q_date"]), ["q"], same, F.lit(1.0))
    own = ["q_key", "q_court", "q_blank", "half"]
    keys = top(q.select(*own).distinct().join(c.groupBy("c_key", "c_court").agg(F.min("c").alias("c")), F.col("q_key") == F.col("c_key")), own, F.lit(0.6), half)
    near = ["core", "q_court", "q_blank", "half"]
    cores = top(q.select(*near).distinct().join(c.groupBy("core", "c_court").agg(F.min("c").alias("c")), "core"), near, F.lit(0.36), half)
    null = lambda df, by, name: df.select(*(F.col(x).alias(f"{name}_{x}") for x in by), F.col("b").alias(name))
    on = lambda by, name: [F.col(x).eqNullSafe(F.col(f"{name}_{x}")) for x in by]
    every = q.join(dated.withColumnRenamed("b", "dated"), "q", "left").join(null(keys, own, "keys"), on(own, "keys"), "left").join(null(cores, near, "cores"), on(near, "cores"), "left")
    n = c.groupBy("core").agg(F.least(F.count("*"), F.lit(most)).alias("candidates"))
    best = every.join(n, "core").select("q", F.greatest("dated", "keys", "cores").alias("b"), "candidates").select("q", "b.score", "b.case_match", "candidates")
    status = F.when(F.col("score").isNull(), "not_found").when(F.col("case_match") & (F.col("score") >= FOUND), "found").otherwise("found_partial")
    return queries.select("q").join(best, "q", "left").select("q", status.alias("status"), "score", F.coalesce("candidates", F.lit(0)).alias("candidates"))
