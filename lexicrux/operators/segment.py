"""Several values packed in one field: one row per value, with its place.

Quoted spans and spans between hard delimiters (line end, tab, |, •, 、) are values as they stand. Commas, semicolons,
slashes, & and `và` may separate values or belong to one; which of them do is decided by segmentation: the places between
them span a lattice of possible values, and Viterbi takes the likeliest way through it. How frequent a value is, is learned
from the whole column by expectation-maximisation: the start are the values that are certain, then every lattice adds its
expected values, until the frequencies stay (or ROUNDS are done). Frequencies are kept by template (numbers, initials and
the letters of one điểm masked), and for values never seen by their first and last word and length, in a sketch that is
sized by the number of different templates (at most MOST_CELLS cells) and can be sent to every worker.

Fields are taken apart once; lattices are then counted by what they look like masked, and learned from and decided once for
each such shape.

Defined results: null and blank fields have no value; empty values between delimiters don't count; a field of one value
comes out with pos 1 (p2_found leaves it out), so does a field whose column (grp) is null, as one value; repeated rows are
split each; clashing column names don't matter, as only the named columns are read. Values are as written, without outer
blanks and quotes, a doubled quote inside made single."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicrux.staging import stage, unstage

#: Cells of a sketch: CELLS for each template, in powers of two, between these bounds.
CELLS, LEAST_CELLS, MOST_CELLS = 8, 1 << 14, 1 << 24
#: Rounds of expectation-maximisation at most, and the share of the frequencies that may still change when it stops.
ROUNDS, SETTLED = 8, 0.002
NEW = 1e-4
#: Cost of one value more, of each word of a value never seen, and of each delimiter inside one.
SPLIT, WORD, INSIDE = 0.3, 0.5, 3.0
#: What a lattice expects of a value is discounted by so much: a field must not vouch for itself.
DISCOUNT = 1.0

HARD = "\n\t|•、"
# letters after điểm belong together
POINTS = re.compile(r"(?i:điểm)\s+[a-zđ](?:\s*(?:,|;|/|&|\bvà\b)\s*[a-zđ](?![\w.]))*(?![\w.])")
PART = rf"(?:[{HARD}]|;|(?<!\d),|,(?!\d)|(?<!\d)/|/(?!\d)|&|(?<!\S)và(?!\S))"
RUN = re.compile(rf"[^\S\n\t]*{PART}(?:\s*{PART})*\s*")
QUOTES = {'"': re.compile(r'"((?:[^"]|"")*)"'), "'": re.compile(r"'((?:[^']|'')*)'"), "“": re.compile(r"“([^”]*)”"), "«": re.compile(r"«([^»]*)»")}
MASKS = ((re.compile(r"[\w.\-]*\d[\w.\-]*"), "0"), (re.compile(r"\b\w(?:\.\w)+\b"), "N"), (POINTS, "điểm L"), (re.compile(r"\s+"), " "))
ANY_DELIMITER = re.compile(rf"[{HARD},;/&]|(?<!\S)và(?!\S)")
OPENING = frozenset("[") | QUOTES.keys()


@lru_cache(100_000)
def template(value: str) -> str:
    for rx, to in MASKS[1:3]:
        value = rx.sub(to, value)
    return MASKS[3][0].sub(" ", MASKS[0][0].sub("0", value)).strip()


def parts(text: str) -> list[tuple[str, list[tuple[str, bool]]]]:
    """A field as certain pieces: ("value", …) as it stands, or ("lattice", atoms) with (text, soft delimiter after it)."""
    s = text.strip()
    if s and s[0] not in OPENING and not ANY_DELIMITER.search(s):
        return [("lattice", [(s, "")])]
    if s[:1] == "[" and s[-1:] == "]" and s[1:-1].strip()[:1] in QUOTES:
        s = s[1:-1].strip()
    out: list[tuple[str, list[tuple[str, bool]]]] = []
    atoms: list[tuple[str, str]] = []  # text and the delimiter run behind it
    fixed = [m.span() for m in POINTS.finditer(s)]
    at, n, start = 0, len(s), 0

    def flush() -> None:
        kept = [a for a in atoms if a[0].strip()]
        if kept:
            out.append(("lattice", list(kept)))
        atoms.clear()

    while at <= n:
        if at == start and at < n and s[at] in QUOTES and (m := QUOTES[s[at]].match(s, at)):
            end = m.end()
            run = RUN.match(s, end)
            if end == n or s[end:].strip() == "" or run:
                flush()
                q = s[at]
                value = m[1].replace(q + q, q).strip() if q in "\"'" else m[1].strip()
                if value:
                    out.append(("value", [(value, "")]))
                at = start = run.end() if run else n + 1
                continue
        run = RUN.search(s, at)
        while run and any(a < run.end() and run.start() < b for a, b in fixed if a < run.start()):
            inside = next(b for a, b in fixed if a < run.start() and run.start() < b)
            run = RUN.search(s, inside)
        if run is None:
            atoms.append((s[start:], ""))
            break
        atoms.append((s[start : run.start()], run[0]))
        if any(c in run[0] for c in HARD) or not s[start : run.start()].strip():
            flush()
        at = start = run.end()
    flush()
    return out


#: Between the masked atoms and delimiters of a lattice's shape.
MARK = "\x1f"


def pieces(group: str | None, text: str) -> list[tuple[str, list[str], int]]:
    """(shape, texts, delimiters inside a quoted value or -1): of a certain value its template and itself, of a lattice its
    masked atoms and delimiters, and both as written, in turns."""
    if group is None:
        v = text.strip()
        if v[:1] in QUOTES and (m := QUOTES[v[0]].fullmatch(v)):
            v = (m[1].replace(v[0] * 2, v[0]) if v[0] in "\"'" else m[1]).strip()
        return [("", [v], -1)] if v else []
    out = []
    for kind, atoms in parts(text):
        if kind == "value" or len(atoms) == 1:
            v = atoms[0][0].strip()
            out.append((template(v), [v], len(RUN.findall(POINTS.sub("điểm L", v))) if kind == "value" else -1))
        else:
            out.append((MARK.join(x for a, d in atoms for x in (template(a), MASKS[3][0].sub(" ", d))), [x for pair in atoms for x in pair], -1))
    return out


class Sketch:
    """Counts under two hashes; the smaller one is taken."""

    def __init__(self, table: np.ndarray):
        self.table, self.cells = table, table.shape[1]

    @staticmethod
    def places(key: str, cells: int) -> tuple[int, int]:
        raw = key.encode("utf-8", "surrogatepass")
        return zlib.crc32(raw) % cells, zlib.adler32(raw + raw[::-1], zlib.crc32(raw, 77)) * 0x9E3779B1 % (1 << 32) % cells

    def get(self, key: str) -> float:
        i, j = self.places(key, self.cells)
        return float(min(self.table[0, i], self.table[1, j]))


def features(group: str, masked: str) -> tuple[str, str, str, int]:
    """Keys of a template, its first and its last word, and the number of its words."""
    words = masked.split(" ")
    return f"t\0{group}\0" + " ".join(words), f"a\0{group}\0{words[0]}", f"z\0{group}\0{words[-1]}", len(words)


class Model:
    def __init__(self, sketch: Sketch, longest: int):
        self.sketch, self.longest, self.cache, self.ways = sketch, longest, {}, {}

    def cost(self, group: str, masked: str, inside: int) -> float:
        """Negative log probability of a value by its template and the number of delimiters inside it."""
        known = self.cache.get((group, masked))
        if known is None:
            t, a, z, n = features(group, masked)
            get = self.sketch.get
            total = get(f"n\0{group}") + 1.0
            whole = get(t) / total
            new = (get(a) + 0.01) / total * (get(z) + 0.01) / total * math.exp(-WORD * n - INSIDE * inside)
            known = SPLIT - math.log((1 - NEW) * whole + NEW * new + 1e-30)
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[group, masked] = known
        return known

    def edges(self, group: str, shape: str) -> list[list[tuple[int, float, str]]]:
        """For each end the values (start, cost, template) that stop there: of `longest` atoms at most, or all of them."""
        masked = shape.split(MARK)
        n = len(masked) // 2
        back: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            text = ""
            for j in range(i, min(n, i + self.longest)):
                text += masked[2 * j]
                back[j + 1].append((i, self.cost(group, text, j - i), text))
                text += masked[2 * j + 1]
        if n > self.longest:
            text = "".join(masked[:-1])
            back[n].append((0, self.cost(group, text, n - 1), text))
        return back

    def cuts(self, group: str, shape: str) -> list[tuple[int, int]]:
        """The likeliest values of a lattice, as ranges of its atoms."""
        known = self.ways.get((group, shape))
        if known is None:
            back = self.edges(group, shape)
            n = len(back) - 1
            least, come = [0.0] + [math.inf] * n, [0] * (n + 1)
            for j in range(1, n + 1):
                for i, c, _ in back[j]:
                    if least[i] + c < least[j]:
                        least[j], come[j] = least[i] + c, i
            known, j = [], n
            while j:
                known.append((come[j], j))
                j = come[j]
            known.reverse()
            if len(self.ways) > 100_000:
                self.ways.clear()
            self.ways[group, shape] = known
        return known

    def best(self, group: str, shape: str, texts: list[str]) -> list[str]:
        return ["".join(texts[2 * i : 2 * j - 1]).strip() for i, j in self.cuts(group, shape)]

    def expected(self, group: str, shape: str) -> list[tuple[str, float]]:
        """Templates of the lattice with the probability that they are part of the way (forward-backward)."""
        back = self.edges(group, shape)
        n = len(back) - 1
        ahead = [0.0] + [-math.inf] * n
        for j in range(1, n + 1):
            xs = [ahead[i] - c for i, c, _ in back[j]]
            top = max(xs)
            ahead[j] = top + math.log(sum(math.exp(x - top) for x in xs))
        behind = [-math.inf] * n + [0.0]
        for j in range(n, 0, -1):
            for i, c, _ in back[j]:
                x = behind[j] - c
                top = max(x, behind[i])
                behind[i] = top + math.log(math.exp(x - top) + math.exp(behind[i] - top))
        return [(text, p) for j in range(1, n + 1) for i, c, text in back[j] if (p := math.exp(ahead[i] - c + behind[j] - ahead[n])) > 1e-4]


def _counted(shapes: DataFrame, cells: int, what, broadcast) -> np.ndarray:
    """Sum over all shapes (grp, shape, n) of n * what(state, group, shape) -> [(template, weight)], as a sketch's table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = broadcast.value if broadcast else None
        table = np.zeros((2, cells), np.float64)
        for batch in batches:
            seen: Counter = Counter()
            for g, shape, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for masked, w in what(state, g, shape):
                    t, a, z, _ = features(g, masked)
                    for key in (t, a, z, f"n\0{g}"):
                        seen[key] += w * n
            for key, w in seen.items():
                i, j = Sketch.places(key, cells)
                table[0, i] += w
                table[1, j] += w
        flat = table.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at], pa.float64())], ["at", "w"])

    rows = shapes.select("grp", "shape", "n").mapInArrow(run, "at INT, w DOUBLE").groupBy("at").agg(F.sum("w").alias("w")).toArrow()
    table = np.zeros(2 * cells, np.float32)
    table[rows.column("at").to_numpy()] = rows.column("w").to_numpy()
    return table.reshape(2, cells)


def learned(taken: DataFrame) -> Model:
    """The model of fields taken apart (grp, p: pieces)."""
    one = taken.where("grp IS NOT NULL").select("grp", F.explode("p").alias("p"))
    shapes = stage(one.groupBy("grp", F.col("p.shape").alias("shape"), (F.size("p.texts") > 1).alias("lattice")).agg(F.count("*").alias("n"), F.max("p.inside").alias("inside")))
    s = shapes.agg(F.max("inside").alias("inside"), F.count("*").alias("n")).first()
    longest = max(s["inside"] or 0, 0) + 6
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << math.ceil(math.log2(CELLS * max(1, s["n"])))))
    sure = _counted(shapes.where("NOT lattice"), cells, lambda _, g, shape: [(shape, 1.0)], None)
    lattices, table = shapes.where("lattice"), sure
    for _ in range(ROUNDS):
        sent = taken.sparkSession.sparkContext.broadcast(Model(Sketch(table), longest))
        new = sure + np.maximum(_counted(lattices, cells, lambda m, g, shape: m.expected(g, shape), sent) - DISCOUNT, 0)
        settled = np.abs(new - table).sum() <= SETTLED * max(1.0, float(new.sum()))
        table = new
        sent.unpersist()
        if settled:
            break
    unstage(shapes)
    return Model(Sketch(table), longest)


def split_values(fields: DataFrame) -> DataFrame:
    """fields: columns of any kind besides grp (the column a value belongs to; null: always one value) and t (the text).

    Gives those other columns, pos from 1, and value."""
    others = [c for c in fields.columns if c not in ("grp", "t")]
    types = dict(fields.dtypes)
    kept = "".join(f"`{c}` {types[c]}, " for c in others)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            shapes, texts, inside, at, ends = [], [], [], [0], [0]
            for g, t in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()):
                for shape, own, k in pieces(g, t):
                    shapes.append(shape)
                    texts += own
                    ends.append(len(texts))
                    inside.append(k)
                at.append(len(shapes))
            flat = pa.StructArray.from_arrays([pa.array(shapes, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(texts, pa.string())), pa.array(inside, pa.int32())], ["shape", "texts", "inside"])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n - 1)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)], [*others, "grp", "p"])

    own = fields.where("t IS NOT NULL").select(*others, "grp", "t")
    taken = stage(own.mapInArrow(take, f"{kept}grp STRING, p ARRAY<STRUCT<shape: STRING, texts: ARRAY<STRING>, inside: INT>>"))
    sent = fields.sparkSession.sparkContext.broadcast(learned(taken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            row, pos, values = [], [], []
            n = batch.num_columns
            for r, (g, ps) in enumerate(zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist())):
                k = 0
                for p in ps:
                    texts = p["texts"]
                    for v in texts if len(texts) == 1 else model.best(g, p["shape"], texts):
                        k += 1
                        row.append(r)
                        pos.append(k)
                        values.append(v)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(n - 2)), pa.array(pos, pa.int32()), pa.array(values, pa.string())], [*others, "pos", "value"])

    # fields without a lattice need no model
    open_ = F.exists("p", lambda x: F.size(x["texts"]) > 1)
    sure = taken.where(~open_).select(*others, F.posexplode(F.transform("p", lambda x: x["texts"][0])).alias("pos", "value")).withColumn("pos", F.col("pos") + 1)
    return sure.unionByName(taken.where(open_).select(*others, "grp", "p").mapInArrow(run, f"{kept}pos INT, value STRING"))


SINGLE = ("COURT", "CASE_NUMBER", "DECISION")


def p2_values(spark, d: str) -> DataFrame:
    cits = spark.read.parquet(f"{d}/parsed_citations.parquet").select(F.lit("parsed_citations").alias("tbl"), F.col("cit_id").cast("string").alias("row_key"), F.lit(0).alias("span_ord"), F.lit("raw").alias("grp"), F.col("raw").alias("t"))
    spans = spark.read.parquet(f"{d}/gold_spans.parquet").select("id", F.posexplode("spans").alias("span_ord", "s")).where("s IS NOT NULL")
    label = F.coalesce("s.label", F.lit(""))
    gold = spans.select(F.lit("gold_spans").alias("tbl"), F.col("id").alias("row_key"), "span_ord", F.when(~label.isin(*SINGLE), label).alias("grp"), F.col("s.text").alias("t"))
    return split_values(cits.unionByName(gold))


def p2_found(spark, d: str) -> DataFrame:
    v = p2_values(spark, d)
    key = ["tbl", "row_key", "span_ord"]
    # pos runs within a field, so the fields of two values or more are those with a pos of 2
    v = stage(v)
    many = v.where("pos = 2").select(*key).distinct()
    return v.join(many, key, "left_semi").select(*key, "pos", "value").distinct()


QUERIES = {"p2_found": p2_found, "p2_values": p2_values}
