"""Problem 6: all pairs of set-valued records that overlap above a threshold.

Extended-prefix join. Sets are ordered by rising frequency of their tokens over the whole table. With prefixes of
|s| - ceil(t |s|) + l tokens, two sets of Jaccard t or more share at least l prefix tokens, so the join runs on
combinations of l prefix tokens. l is chosen among 1, 2 and 3 by the exact cost of each over all data: keys to be
shuffled plus pairs to be compared. Candidates of fitting sizes are then verified on whole sets.

Records with the same set are joined once, through the least key among them: p6_pairs and p6_classes give the pairs of
classes and the membership, p6_found all pairs of records, whatever the size of a class. A key of many sets is split into
blocks of HOT, each pair of blocks being joined by itself.

Defined results: null, empty and blank elements are left out; a set under `least` elements has no pairs; repeated elements
count once; records with equal sets are a pair like others."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicrux.llm.copies import all_pairs
from lexicrux.staging import stage

NUM, DEN = 4, 5  # the threshold 0.8 as a fraction, for exact bounds
LEAST = 10
SALTS = 8
#: Sets of one key that one task joins with as many others at most.
HOT = 4096
ZEROS = re.compile(r"(?<!\d)0+(?=\d)")


def canonical(x: str) -> str:
    return ZEROS.sub("", " ".join(unicodedata.normalize("NFC", x).lower().split()))


def token_sets(rows: DataFrame, key: str, fields: list[str], least: int = LEAST) -> DataFrame:
    """key and toks: sorted hashes of the canonical elements; only sets of at least `least` elements."""
    kind = dict(rows.select(key).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            out = []
            if len(known) > 200_000:
                known.clear()
            for lists in zip(*(batch.column(i).to_pylist() for i in range(1, batch.num_columns))):
                s = set()
                for xs in lists:
                    for x in xs or ():
                        if x is not None:
                            if (c := known.get(x)) is None:
                                c = known[x] = canonical(x)
                            s.add(c)
                s.discard("")
                out.append(sorted(s) if len(s) >= least else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["k", "s"])

    raw = rows.select(F.col(key).alias("k"), *(F.col(f).alias(f"f{i}") for i, f in enumerate(fields)))
    # elements before cleaning are at least as many as after it
    raw = raw.where(sum((F.greatest(F.size(f"f{i}"), F.lit(0)) for i in range(len(fields))), F.lit(0)) >= least)
    sets = raw.mapInArrow(run, f"k {kind}, s ARRAY<STRING>").where("s IS NOT NULL")
    return sets.select("k", F.array_sort(F.transform("s", lambda x: F.xxhash64(x))).alias("toks"))


def combinations(prefix: Column, n: int) -> Column:
    """Hashes of all combinations of n elements of an ordered array."""
    rest = lambda i: F.slice(prefix, i + 2, F.size(prefix))
    if n == 1:
        return prefix
    if n == 2:
        return F.flatten(F.transform(prefix, lambda x, i: F.transform(rest(i), lambda y: F.xxhash64(x, y))))
    return F.flatten(
        F.transform(prefix, lambda x, i: F.flatten(F.transform(rest(i), lambda y, j: F.transform(F.slice(prefix, i + j + 3, F.size(prefix)), lambda z: F.xxhash64(x, y, z)))))
    )


def keyed(ordered: DataFrame, n: int) -> DataFrame:
    size = F.size("toks")
    prefix = F.slice("toks", 1, F.least(size, size - F.floor((size * NUM + DEN - 1) / DEN).cast("int") + n))
    return ordered.select("rep", size.alias("size"), F.explode(combinations(prefix, n)).alias("key"))


def candidates(keys: DataFrame) -> DataFrame:
    """rep_a < rep_b of fitting sizes that share a key (rep, size, key)."""
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")
    many = keys.groupBy("key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("blocks")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = keys.withColumn("salt", salt).join(many, ["key", "salt"]).withColumn("own", F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = keys.select("key", F.col("own").alias("block_a"), other.alias("block_b"), F.col("rep").alias("rep_a"), F.col("size").alias("size_a"))
    b = keys.select("key", other.alias("block_a"), F.col("own").alias("block_b"), F.col("rep").alias("rep_b"), F.col("size").alias("size_b"))
    fits = (F.col("rep_a") < F.col("rep_b")) & (F.col("size_a") * NUM <= F.col("size_b") * DEN) & (F.col("size_b") * NUM <= F.col("size_a") * DEN)
    return a.join(b, ["key", "block_a", "block_b"]).where(fits).select("rep_a", "rep_b").distinct()


def similar_sets(rows: DataFrame, key: str, fields: list[str], least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives: rep_a < rep_b, common, united; membership: key, rep, copies)."""
    sets = stage(token_sets(rows, key, fields, least))
    groups = stage(sets.groupBy("toks").agg(F.min("k").alias("rep"), F.count("*").alias("copies")))
    members = sets.join(groups, "toks").select(F.col("k").alias(key), "rep", "copies").distinct()
    flat = groups.select("rep", F.explode("toks").alias("tok"))
    freq = flat.groupBy("tok").agg(F.count("*").alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ranked = flat.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(freq, ["tok", "salt"])
    ordered = stage(ranked.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "tok"))), lambda x: x["tok"]).alias("toks")))
    cost = {}
    for n in (1, 2, 3):
        c = keyed(ordered, n).groupBy("key").agg(F.count("*").alias("n")).agg(F.sum("n").alias("keys"), F.sum(F.col("n") * (F.col("n") - 1.0) / 2).alias("pairs")).first()
        cost[n] = 3 * (c["keys"] or 0) + (c["pairs"] or 0)
    pairs = candidates(keyed(ordered, min(cost, key=lambda n: (cost[n], n))))
    toks = ordered.select("rep", "toks")
    full = pairs.join(toks.withColumnsRenamed({"rep": "rep_a", "toks": "toks_a"}), "rep_a").join(toks.withColumnsRenamed({"rep": "rep_b", "toks": "toks_b"}), "rep_b")
    common = F.size(F.array_intersect("toks_a", "toks_b"))
    checked = full.select("rep_a", "rep_b", common.alias("common"), (F.size("toks_a") + F.size("toks_b") - common).alias("united"))
    return checked.where(F.col("common") * DEN >= F.col("united") * NUM), members


def expanded(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Pairs of records out of pairs of classes and of all records within a class."""
    same = members.where("copies > 1").select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")).distinct()
    return all_pairs(pairs.select("rep_a", "rep_b").unionByName(same), members.select(F.col(key).alias("k"), "rep", "copies"))


def _classes(spark, d: str) -> tuple[DataFrame, DataFrame]:
    pairs, members = similar_sets(spark.read.parquet(f"{d}/precedents.parquet"), "rec_no", ["crimes", "articles"])
    return stage(pairs), stage(members)


def p6_found(spark, d: str) -> DataFrame:
    pairs, members = _classes(spark, d)
    return expanded(pairs, members, "rec_no")


def p6_pairs(spark, d: str) -> DataFrame:
    """Pairs of classes of equal sets by their least rec_no, with the sizes of what they have in common and united."""
    return _classes(spark, d)[0]


def p6_classes(spark, d: str) -> DataFrame:
    """One row per record with a set of ten or more: its class of equal sets and the number of similar classes."""
    pairs, members = _classes(spark, d)
    links = pairs.select(F.col("rep_a").alias("rep")).unionByName(pairs.select(F.col("rep_b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(links, "rep", "left").select("rec_no", F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


_SETS = r"""
WITH e AS (SELECT rec_no, unnest(list_concat(coalesce(crimes, []), coalesce(articles, []))) AS x FROM precedents),
c AS (SELECT DISTINCT rec_no, regexp_replace(regexp_replace(trim(regexp_replace(lower(nfc_normalize(x)), '\s+', ' ', 'g')), '^0+(\d)', '\1'), '([^0-9])0+([0-9])', '\1\2', 'g') AS x FROM e WHERE x IS NOT NULL),
k AS (SELECT rec_no, count(*) AS n FROM c WHERE x <> '' GROUP BY rec_no HAVING count(*) >= 10),
t AS (SELECT c.rec_no, x, n FROM c JOIN k USING (rec_no) WHERE x <> '')
"""
_CLASSES = (
    _SETS
    + r""", g AS (SELECT rec_no, list_sort(list(x)) AS s FROM t GROUP BY rec_no), q AS (SELECT s, min(rec_no) AS rep, count(*) AS copies FROM g GROUP BY s), m AS (SELECT rec_no, rep, copies FROM g JOIN q USING (s)),
u AS (SELECT t.* FROM t JOIN q ON rec_no = rep),
j AS (SELECT a.rec_no AS rep_a, b.rec_no AS rep_b, CAST(count(*) AS INTEGER) AS common, CAST(any_value(a.n) + any_value(b.n) - count(*) AS INTEGER) AS united FROM u a JOIN u b ON a.x = b.x AND a.rec_no < b.rec_no GROUP BY ALL HAVING count(*) * 5 >= 4 * (any_value(a.n) + any_value(b.n) - count(*)))
"""
)
QUERIES = {"p6_found": p6_found, "p6_pairs": p6_pairs, "p6_classes": p6_classes}
SQL = {
    "p6_found": _SETS + "SELECT a.rec_no AS rec_a, b.rec_no AS rec_b FROM t a JOIN t b ON a.x = b.x AND a.rec_no < b.rec_no GROUP BY a.rec_no, b.rec_no HAVING count(*) * 5 >= 4 * (any_value(a.n) + any_value(b.n) - count(*))",
    "p6_pairs": _CLASSES + "SELECT rep_a, rep_b, common, united FROM j",
    "p6_classes": _CLASSES + ", l AS (SELECT rep, count(*) AS links FROM (SELECT rep_a AS rep FROM j UNION ALL SELECT rep_b FROM j) GROUP BY rep) SELECT rec_no, rep AS class_id, copies, coalesce(links, 0) AS links FROM m LEFT JOIN l USING (rep)",
}
