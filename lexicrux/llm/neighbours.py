"""Problem 3: the most similar vectors of every vector.

A hierarchical k-means tree is fitted on a bounded sample (about SAMPLE vectors a dimension, by hash); leaves that hold more
than 2 LEAF of all vectors are split again, by trees fitted in the executors on bounded samples of their own, until none is
larger or MOST_LEAVES are reached. Every distinct vector is put into one leaf. A query walks the tree best bin first
through a priority queue and visits leaves; how many is calibrated: CALIBRATE other sampled queries are compared with all vectors
by brute force, and the least number of visits that reaches RECALL is taken. Where all vectors ask, a pair is found from
either side, and calibrated so. Leaves are compared in blocks of about BLOCK by ASKS vectors.

A row is shipped once for its own leaf, where it both asks and is asked for, and once for each further leaf it visits.

Vectors that are equal are searched once and get their copies back at the end, all of them.

Defined results: a vector is usable if `dim` is its length and all values are finite and not all zero; others have no row.
Ties: every vector of the same cosine (to nine places) as the k-th counts, copies and scaled copies too, so that the rows
grow with the square of such a group. Cosines are computed in double precision."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexicrux.llm.copies import all_pairs
from lexicrux.staging import bounded, stage, unstage

SAMPLE = 4096
LEAF = 2048
FANOUT = 16
#: Sampled vectors that a leaf is fitted on at least, and the most leaves of one dimension's tree.
FITTED = 64
MOST_LEAVES = 65_536
#: Times that leaves are split again; each multiplies their number by up to SAMPLE / FITTED.
GROWTHS = 6
CALIBRATE = 2048
RECALL = 0.9995
#: Rows that are asked for, and that ask, in one task.
BLOCK, ASKS = 8192, 65_536
SLICE = 512
MOST_DIMS = 64


class Tree:
    """Nodes as lists: centroids, children; leaves are numbered."""

    def __init__(self, x: np.ndarray, rows: int, full: int, fitted: int, most: int, seed: int = 7):
        """x: a sample of so many rows; full: rows of a leaf; fitted: sampled rows of a leaf at least."""
        self.centre, self.kids, self.leaf, self.leaves = [x.mean(0)], [[]], [-1], 0
        rng = np.random.default_rng(seed)
        todo = [(0, x)]
        while todo:
            node, part = todo.pop()
            want = len(part) / max(1, len(x)) * rows / full
            if want <= 1.5 or len(part) < 2 * fitted or self.leaves + len(todo) >= most or (near := self._split(part, min(FANOUT, max(2, math.ceil(want))), rng)) is None:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for j in np.unique(near):
                own = part[near == j]
                todo.append((self._add(node, own.mean(0)), own))
        self._ready()

    def _add(self, parent: int, centre: np.ndarray) -> int:
        self.kids[parent].append(len(self.centre))
        self.centre.append(centre / max(np.linalg.norm(centre), 1e-12))
        self.kids.append([]), self.leaf.append(-1)
        return len(self.centre) - 1

    def _ready(self) -> None:
        self.matrix = [np.array([self.centre[w] for w in ws], np.float32) if ws else None for ws in self.kids]

    @staticmethod
    def _split(x: np.ndarray, k: int, rng) -> np.ndarray | None:
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            near = np.argmax(x @ c.T, 1)
            for j in range(k):
                if (own := near == j).any():
                    m = x[own].mean(0)
                    c[j] = m / max(np.linalg.norm(m), 1e-12)
        near = np.argmax(x @ c.T, 1)
        return near if len(np.unique(near)) > 1 else None

    def branches(self) -> list[tuple[int, int, list[float]]]:
        """(node, parent, centroid) of all nodes below the root, parents first."""
        return [(w, v, self.centre[w].tolist()) for v in range(len(self.kids)) for w in self.kids[v]]

    def graft(self, leaf: int, branches: list[tuple[int, int, list[float]]]) -> None:
        """The leaf becomes the root of these branches; its number is given up."""
        at = {0: self.leaf.index(leaf)}
        self.leaf[at[0]] = -1
        for node, parent, centre in sorted(branches):
            at[node] = self._add(at[parent], np.array(centre))
        for v in at.values():
            if not self.kids[v]:
                self.leaf[v] = self.leaves
                self.leaves += 1

    def walk(self, x: np.ndarray) -> Iterator[Iterator[int]]:
        """For each row its leaves in the order best-bin-first reaches them, found as far as they are asked for."""
        kids, leaf, matrix = self.kids, self.leaf, self.matrix

        def one(row: np.ndarray, scores: list[float]) -> Iterator[int]:
            heap = [(-s, w) for s, w in zip(scores, kids[0])]
            heapq.heapify(heap)
            while heap:
                _, v = heapq.heappop(heap)
                if leaf[v] >= 0:
                    yield leaf[v]
                else:
                    for s, w in zip((matrix[v] @ row).tolist(), kids[v]):
                        heapq.heappush(heap, (-s, w))

        if leaf[0] >= 0:
            return (iter(leaf[:1]) for _ in x)
        return (one(row, scores) for row, scores in zip(x, (x @ matrix[0].T).tolist()))

    def visit(self, x: np.ndarray, most: int) -> list[list[int]]:
        """For each row the first `most` leaves."""
        return [list(islice(w, most)) for w in self.walk(x)]

    def places(self, x: np.ndarray, wanted: list[set[int]]) -> list[dict[int, int]]:
        """For each row at which visit it reaches each of the leaves wanted; no row walks further than that."""
        out = []
        for w, leaves in zip(self.walk(x), wanted):
            found: dict[int, int] = {}
            for i, v in enumerate(w if leaves else ()):
                if v in leaves:
                    found[v] = i
                    if len(found) == len(leaves):
                        break
            out.append(found)
        return out


def matrix(col: pa.Array, dtype=np.float32) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros((0, 1), dtype)
    m = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.float64)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(dtype)


def usable(rows: DataFrame, key: str = "rec_no", vector: str = "vector", dim: str = "dim") -> DataFrame:
    good = (F.col(dim) == F.size(vector)) & (F.size(vector) > 0)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(good & finite & F.exists(vector, lambda x: x != 0)).select(F.col(key).alias("k"), F.col(dim).alias("dim"), F.col(vector).alias("v"), F.xxhash64(F.lit(1), vector).alias("h"))


def _top(sims: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row that reach `least`, with ties of the k-th."""
    rows = np.flatnonzero((sims >= least).any(1))
    own = sims[rows]
    if own.shape[1] > k and len(rows):
        kth = np.partition(own, own.shape[1] - k, 1)[:, -k]
        i, j = np.nonzero(own >= np.maximum(kth - 1e-6, least)[:, None])
    else:
        i, j = np.nonzero(own >= least)
    return rows[i], j


def _exact(base: DataFrame, queries: np.ndarray, ids: list, k: int, least: float) -> DataFrame:
    """Brute force of a bounded number of queries against all rows: q, k, sim; of ties only k a query."""
    sent = base.sparkSession.sparkContext.broadcast((queries, np.array(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names = sent.value
        for batch in batches:
            keys = batch.column(0).to_numpy()
            sims = q @ matrix(batch.column(1)).T
            sims[names[:, None] == keys[None, :]] = -2
            i, j = _top(sims, k, max(least, -1.5))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(keys[j], pa.int64()), pa.array(sims[i, j].astype(np.float64))], ["q", "k", "sim"])

    found = base.select("k", "v").mapInArrow(run, "q INT, k BIGINT, sim DOUBLE")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "k"))).where(F.col("r") <= k).drop("r")


def _leaf_of(base: DataFrame, tree: Tree, most: int) -> DataFrame:
    """Rows with the leaves they visit: k, v, leaf, visit (0: the leaf a row belongs to)."""
    sent = base.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for batch in batches:
            got = t.visit(matrix(batch.column(1)), most)
            n = np.array([len(g) for g in got], np.int64)
            row = np.repeat(np.arange(len(got)), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array([x for g in got for x in g], pa.int32()), pa.array(np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), pa.int32())],
                ["k", "v", "leaf", "visit"],
            )

    return base.select("k", "v").mapInArrow(run, "k BIGINT, v ARRAY<FLOAT>, leaf INT, visit INT")


def _part(salt: int, share) -> F.Column:
    """Whether a row's hash puts it into a sample of about this share."""
    return F.pmod(F.xxhash64(F.lit(salt), "k"), F.lit(1 << 30)) < share * (1 << 30)


def _grown(base: DataFrame, tree: Tree) -> Tree:
    """The tree with leaves of at most 2 LEAF rows, as far as vectors can be told apart and MOST_LEAVES allows."""
    for _ in range(GROWTHS):
        home = _leaf_of(base, tree, 1)
        large = {r["leaf"]: r["n"] for r in bounded(home.groupBy("leaf").agg(F.count("*").alias("n")), MOST_LEAVES, "the leaves") if r["n"] > 2 * LEAF}
        room = MOST_LEAVES - tree.leaves
        if not large or room < len(large):
            return tree
        full, fitted, most = LEAF, FITTED, min(SAMPLE // FITTED, 1 + room // len(large))
        rate = base.sparkSession.createDataFrame([(x, n, min(1.0, min(most, math.ceil(n / LEAF)) * FITTED / n)) for x, n in large.items()], "leaf INT, n BIGINT, share DOUBLE")
        sample = home.join(F.broadcast(rate), "leaf").where(_part(9, F.col("share"))).select("leaf", "n", "v")

        def fit(t: pa.Table) -> pa.Table:
            rows = Tree(matrix(t.column("v")), t.column("n")[0].as_py(), full, fitted, most).branches()
            leaf = t.column("leaf")[0].as_py()
            return pa.table([pa.array([leaf] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float32()))], ["leaf", "node", "parent", "centre"])

        grown: dict[int, list] = {}
        for r in bounded(sample.groupBy("leaf").applyInArrow(fit, "leaf INT, node INT, parent INT, centre ARRAY<FLOAT>"), 2 * MOST_LEAVES, "the nodes"):
            grown.setdefault(r["leaf"], []).append((r["node"], r["parent"], r["centre"]))
        if not grown:
            return tree
        for leaf, branches in sorted(grown.items()):
            tree.graft(leaf, branches)
        tree._ready()
    return tree


def _calibrated(base: DataFrame, tree: Tree, sample: np.ndarray, ids: list, k: int, least: float, recall: float, both: bool) -> int:
    """The visits that reach the recall; both: a pair may be found from either of its sides."""
    q, names = sample[:CALIBRATE], ids[:CALIBRATE]
    for bound in (least, -1.0):  # if no sampled query has a neighbour that near, the nearest of all are looked for
        truth = _exact(base, q, names, k, bound)
        near = bounded(truth.join(base.select("k", "v"), "k").select("q", "v"), CALIBRATE * k, "the calibration's neighbours")
        if near:
            break
    else:
        return 1
    x = matrix(pa.array([r.v for r in near], pa.list_(pa.float32())))
    of = [g[0] for g in tree.visit(x, 1)]  # the leaf each neighbour is in
    wanted: list[set[int]] = [set() for _ in q]
    for r, v in zip(near, of):
        wanted[r.q].add(v)
    there = tree.places(q, wanted)
    at = [there[r.q][v] for r, v in zip(near, of)]
    if both:
        home = [g[0] for g in tree.visit(q, 1)]
        back = tree.places(x, [{home[r.q]} for r in near])
        at = [min(i, g[home[r.q]]) for i, r, g in zip(at, near, back)]
    at.sort()
    return at[min(len(at) - 1, math.ceil(recall * len(at)) - 1)] + 1


def _blocked(rows: DataFrame, asked: F.Column, asks: F.Column) -> DataFrame:
    """Rows for the blocks of their leaf: role 1 is asked for, 2 asks, 3 both. asked, asks: which rows have which role."""
    count = lambda c, most: F.ceil(F.count_if(c) / most).cast("int")
    n = rows.groupBy("leaf").agg(count(asked, BLOCK).alias("nd"), count(asks, ASKS).alias("nq")).where("nd > 0 AND nq > 0")
    own = lambda c: F.pmod(F.xxhash64(F.lit(4), "k"), F.col(c)).cast("int")
    every = lambda c, make: F.transform(F.sequence(F.lit(0), F.col(c) - 1), make)
    at = lambda d, q, role: F.struct(d.alias("db"), q.alias("qb"), F.lit(role).alias("role"))
    none = F.array().cast("array<struct<db:int,qb:int,role:int>>")
    places = F.concat(F.when(asked, every("nq", lambda x: at(own("nd"), x, 1))).otherwise(none), F.when(asks, every("nd", lambda x: at(x, own("nq"), 2))).otherwise(none))
    places = F.when(asked & asks & (F.col("nd") == 1) & (F.col("nq") == 1), F.array(at(F.lit(0), F.lit(0), 3))).otherwise(places)
    # at most MOST_LEAVES rows of three numbers
    return rows.join(F.broadcast(n), "leaf").select("k", "v", "leaf", F.explode(places).alias("p")).select("k", "v", "leaf", "p.*")


def nearest(base: DataFrame, k: int, least: float = -1.0, queries: DataFrame | None = None, recall: float = RECALL) -> DataFrame:
    """Of distinct vectors of one dimension (k BIGINT, v): a, b, sim, the k best b of each a that reach `least`.

    queries: the rows of base that ask (default: all). The result is staged."""
    spark = base.sparkSession
    rows = base.count()
    if rows == 0:
        return spark.createDataFrame([], "a BIGINT, b BIGINT, sim DOUBLE")
    most = SAMPLE + CALIBRATE
    got = base.where(_part(5, most / rows)).toArrow() if rows > most else base.toArrow()
    mix = np.random.default_rng(5).permutation(len(got))  # stored order tells rows apart, a sample must not
    got = got.sort_by("k").take(pa.array(mix))
    sample = matrix(got.column("v"))
    # the queries of the calibration have no part in the fit, unless there are too few rows
    fit = sample[CALIBRATE:] if len(sample) >= 2 * CALIBRATE else sample
    tree = _grown(base, Tree(fit.copy(), rows, LEAF, FITTED, MOST_LEAVES))
    visits = _calibrated(base, tree, sample, got.column("k").to_pylist(), k, least, recall, queries is None)
    home = F.col("visit") == 0
    if queries is None:
        walked = stage(_leaf_of(base, tree, visits))
        cells = _blocked(walked, home, F.lit(True))
    else:
        walked = stage(_leaf_of(base, tree, 1).unionByName(_leaf_of(queries, tree, visits).withColumn("visit", F.col("visit") - visits)))
        cells = _blocked(walked, home, F.col("visit") < 0)

    def compare(t: pa.Table) -> pa.Table:
        role = t.column("role").to_numpy()
        keys, m = t.column("k").to_numpy(), matrix(t.column("v"), np.float64)
        d, q = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        found = []
        if len(d) and len(q):
            near = m.astype(np.float32)
            dm, dk = near[d].T, keys[d]
            for lo in range(0, len(q), SLICE):
                own = q[lo : lo + SLICE]
                sims = near[own] @ dm
                sims[keys[own][:, None] == dk[None, :]] = -2
                i, j = _top(sims, k, max(least - 1e-5, -1.5))
                for at in range(0, len(i), 65_536):
                    a, b = own[i[at : at + 65_536]], d[j[at : at + 65_536]]
                    s = np.einsum("ij,ij->i", m[a], m[b])
                    keep = s >= least - 1e-12
                    found.append((keys[a[keep]], keys[b[keep]], s[keep]))
        cols = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0)] * 3
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["a", "b", "sim"])

    pairs = cells.groupBy("leaf", "db", "qb").applyInArrow(compare, "a BIGINT, b BIGINT, sim DOUBLE")
    if queries is None:  # a pair that one side missed is taken from the other
        pairs = pairs.select(F.explode(F.array(F.struct("a", "b", "sim"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))).alias("p")).select("p.*")
    pairs = pairs.groupBy("a", "b").agg(F.round(F.max("sim"), 9).alias("sim"))
    out = stage(pairs.withColumn("r", F.rank().over(Window.partitionBy("a").orderBy(F.desc("sim")))).where(F.col("r") <= k).drop("r"))
    unstage(walked)
    return out


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, dim, v, copies of one row per distinct vector; membership k, rep, copies of vectors that are there twice)."""
    rows = stage(rows)
    grp = stage(rows.groupBy("dim", "h").agg(F.min("k").alias("rep"), F.count_distinct("k").alias("copies")))
    reps = stage(rows.join(grp.select(F.col("rep").alias("k"), "copies"), "k").select("k", "dim", "v", "copies").dropDuplicates(["k"]))
    twice = rows.select("k", "dim", "h").distinct().join(grp.where("copies > 1"), ["dim", "h"])
    out = reps, stage(twice.select("k", "rep", "copies"))
    unstage(rows, grp)
    return out


def _neighbours(reps: DataFrame, k: int, least: float, asks=lambda dim: None, recall: float = RECALL) -> DataFrame:
    """nearest() of each dimension."""
    out = reps.sparkSession.createDataFrame([], "a BIGINT, b BIGINT, sim DOUBLE")
    for r in bounded(reps.select("dim").distinct().orderBy("dim"), MOST_DIMS, "the dimensions"):
        out = out.unionByName(nearest(reps.where(F.col("dim") == r["dim"]).select("k", "v"), k, least, asks(r["dim"]), recall))
    return out


def similar_pairs(rows: DataFrame, k: int, least: float) -> DataFrame:
    """rec_a < rec_b of the same dim whose cosine reaches `least` and of which one is among the other's k nearest."""
    reps, twice = distinct_vectors(rows)
    out = _neighbours(reps, k, least)
    # copies: rows of the asker's own group come before all others, and b's copies push later neighbours back
    size = reps.where("copies > 1").select("k", "copies")
    n = lambda c, name: (size.select(F.col("k").alias(c), F.col("copies").alias(name)), c, "left")
    w = Window.partitionBy("a").orderBy(F.desc("sim")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    x = out.join(*n("a", "na")).join(*n("b", "nb")).na.fill(1, ["na", "nb"])
    # scaled copies tie with the group itself, at a cosine of 1
    x = x.withColumn("same", F.sum("nb").over(Window.partitionBy("a", "sim"))).withColumn("before", F.when(F.col("sim") < 1, F.col("na") - 1).otherwise(0) + F.sum("nb").over(w) - F.col("same")).where(F.col("before") < k)
    pairs = x.select(F.least("a", "b").alias("rep_a"), F.greatest("a", "b").alias("rep_b")).distinct()
    within = size.select(F.col("k").alias("rep_a"), F.col("k").alias("rep_b"))
    once = reps.where("copies = 1").select("k", F.col("k").alias("rep"), F.lit(1).cast("bigint").alias("copies"))
    return all_pairs(pairs.unionByName(within), twice.unionByName(once))


def p3_found(spark, d: str) -> DataFrame:
    return similar_pairs(usable(spark.read.parquet(f"{d}/precedents.parquet")), 5, 0.90)


def p3_knn(spark, d: str) -> DataFrame:
    """The 5 nearest of every row whose rec_no is divisible by 100, among all rows: rec_no, neighbour, cosine, rank."""
    rows = stage(usable(spark.read.parquet(f"{d}/precedents.parquet")))
    reps, twice = distinct_vectors(rows)
    asks = rows.where("k % 100 = 0")
    out = _neighbours(reps, 5, -1.0, lambda dim: asks.where(F.col("dim") == dim).select("k", "v"), 0.97)
    first = twice.withColumn("no", F.row_number().over(Window.partitionBy("rep").orderBy("k"))).where("no <= 6")
    full = out.join(first.select(F.col("rep").alias("b"), F.col("k").alias("bk")), "b", "left").select("a", F.coalesce("bk", "b").alias("b"), "sim").where("a <> b")
    ranked = full.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b")))
    return ranked.where("rank <= 5").select(F.col("a").alias("rec_no"), F.col("b").alias("neighbour"), F.round("sim", 6).alias("cosine"), "rank")


QUERIES = {"p3_found": p3_found, "p3_knn": p3_knn}
_USABLE = r"""
WITH u AS (SELECT rec_no, dim, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM precedents
  WHERE dim = len(vector) AND len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
s AS (SELECT a.rec_no AS a, b.rec_no AS b, list_cosine_similarity(a.v, b.v) AS sim FROM u a JOIN u b ON a.dim = b.dim AND a.rec_no <> b.rec_no)
"""
SQL = {
    "p3_found": _USABLE
    + "SELECT DISTINCT least(a, b) AS rec_a, greatest(a, b) AS rec_b FROM (SELECT a, b, sim, rank() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC) AS r FROM s) WHERE r <= 5 AND sim >= 0.90"
}
