"""Problem 9: held-out items inside training text.

A generalised suffix automaton of the normalised items is built on the driver and sent once to each Python worker. Items of
more than MOST_WORDS words in all are spread by hash over several automata, built, sent and gone through one after the
other, so that neither the driver nor a worker holds more than one. Pages are streamed through; wherever the longest match
has LEAST words or more, the items that hold its last LEAST words are reported and the span can be removed.

Words are longest runs of letters and digits; case, accents and what stands between words don't matter. A run of LEAST
words none of which is missing from the items' vocabulary is needed for a match, so only such runs enter the automaton.

Defined results: null and empty texts match nothing; items of fewer than LEAST words match nothing; items or pages repeated
are reported each; ties don't arise, every item that shares a run is reported. One item alone of more than 4 MOST_WORDS
words is refused."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicrux.staging import stage

LEAST = 12
#: Words of the items in one automaton, about.
MOST_WORDS = 500_000
_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point -> its folded letter or digit, 32 where words end, 0 for marks, which are dropped."""
    if not _FOLD:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if 0xAC00 <= c < 0xD7A4 or 0x3400 <= c < 0xA000 or 0x17000 <= c < 0x18D00 or 0x20000 <= c < 0x32000:
                t[c] = c
                continue
            if 0xD800 <= c < 0xF900 or c >= 0xE0000 or (0x323B0 <= c):
                continue
            ch = chr(c)
            if c < 128:
                t[c] = ord(ch.lower()) if ch.isalnum() else 32
            elif ch in "đĐ":
                t[c] = ord("d")
            elif unicodedata.category(ch)[0] == "M":
                t[c] = 0
            elif ch.isalnum():
                t[c] = ord(unicodedata.normalize("NFD", ch.lower())[0])
        _FOLD.append(t)
    return _FOLD[0]


def words(text: str) -> list[str]:
    a = fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return a[a != 0].tobytes().decode("utf-32-le").split()


def word_spans(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words with the character ranges they stand at."""
    a = fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = a != 32
    turn = np.diff(inside)
    rows = [(w, i, j) for i, j in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()) if (w := a[i:j][a[i:j] != 0].tobytes().decode("utf-32-le"))]
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


class Automaton:
    """Generalised suffix automaton over word numbers; owners[v]: the items that hold the strings of v, for states that
    stand for a suffix of exactly LEAST words."""

    def __init__(self, items: list[tuple[object, list[str]]], least: int = LEAST):
        self.least, self.ids, self.vocab = least, [k for k, _ in items], {}
        self.next, self.link, self.length = [{}], [-1], [0]
        own: dict[int, set[int]] = {}
        for n, (_, ws) in enumerate(items):
            last = 0
            for w in ws:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
        for n, (_, ws) in enumerate(items):
            v = 0
            for w in ws:
                v = self.next[v][self.vocab[w]]
                u = v
                while u > 0 and n not in own.setdefault(u, set()):
                    own[u].add(n)
                    u = self.link[u]
        self.top = [-1] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[v] >= least:
                up = self.link[v]
                self.top[v] = v if self.length[up] < least else self.top[up]
        self.owners = {v: sorted(own[v]) for v in set(self.top) - {-1}}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, c)
        cur = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        k = len(nxt)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = k
            p = link[p]
        link[q] = k
        return k

    def runs(self, ws: list[str]) -> Iterator[tuple[int, int, int]]:
        """(state, first word, end word) wherever the longest match has at least `least` words."""
        vocab, nxt, link, length, least = self.vocab, self.next, self.link, self.length, self.least
        ids = [vocab.get(w, -1) for w in ws]
        known = np.zeros(len(ids) + 2, np.int8)
        known[1:-1] = np.array(ids, np.int64) >= 0
        turn = np.diff(known)
        for i, j in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
            if j - i < least:
                continue
            v = n = 0
            for at in range(i, j):
                c = ids[at]
                while v and c not in nxt[v]:
                    v = link[v]
                    n = length[v]
                if c in nxt[v]:
                    v = nxt[v][c]
                    n += 1
                    if n >= least:
                        # n may lie under the shortest string of v's ancestors that are as long as `least`
                        yield self.top[v], at + 1 - n, at + 1


def automata(items: DataFrame, item: str, item_text: str, least: int) -> Iterator[Automaton]:
    """Automata over all items, as many as their words need; none if no item can share a run."""
    own = items.where(F.col(item).isNotNull() & (F.length(item_text) > 2 * least - 2)).select(F.col(item).alias("i"), F.col(item_text).alias("t"))
    # a word takes two characters at least, four and a half in most languages; hashing spreads the rest
    chars = own.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-chars // (3 * MOST_WORDS))
    for shard in range(n):
        normal = [(r.i, words(r.t)) for r in own.where(F.pmod(F.xxhash64("i"), F.lit(n)) == shard).toLocalIterator()]
        if (size := sum(len(w) for _, w in normal)) > 4 * MOST_WORDS:
            raise ValueError(f"an item is too long: {size} words in one automaton")
        yield Automaton(normal, least)


def leaked(pages: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per page and item that share `least` words in a row: key, item, words in common runs, longest run."""
    kinds = dict(pages.select(key).dtypes)[key], dict(items.select(item).dtypes)[item]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = f"k {kinds[0]}, i {kinds[1]}, shared_words INT, longest_run INT"
    found = pages.where(F.length(text) > 2 * least - 2).select(F.col(key).alias("k"), F.col(text).alias("t"))

    def through(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = sent.value
            for batch in batches:
                out: list[tuple] = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    hit: dict[int, list[int]] = {}
                    for v, i, j in auto.runs(words(t)):
                        for n in auto.owners[v]:
                            at = hit.setdefault(n, [0, 0, -1])
                            at[0] += j - max(at[2], j - auto.least)
                            at[1], at[2] = max(at[1], j - i), j
                    out += [(k, auto.ids[n], at[0], at[1]) for n, at in hit.items()]
                cols = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], arrow[kinds[0]]), pa.array(cols[1], arrow[kinds[1]]), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["k", "i", "shared_words", "longest_run"])

        return run

    out, before = None, None
    for auto in automata(items, item, item_text, least):
        if before is not None:  # the last one is done with before the next is built
            before = stage(before)
            out = before if out is None else out.unionByName(before)
        before = found.mapInArrow(through(pages.sparkSession.sparkContext.broadcast(auto)), schema)
    if before is None:
        out = pages.sparkSession.createDataFrame([], schema)
    else:
        out = before if out is None else out.unionByName(before)
    return out.withColumnsRenamed({"k": key, "i": item})


def cleaned(pages: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST, drop_share: float = 0.5) -> DataFrame:
    """Pages without the leaked spans: key, clean_text (null where leaked words make more than drop_share of the page),
    removed_words. Pages without a leak come out as they are."""
    kind = dict(pages.select(key).dtypes)[key]
    part = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))
    schema = f"k {kind}, t STRING, spans ARRAY<STRUCT<i: INT, j: INT>>"

    def through(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = sent.value
            for batch in batches:
                out = []
                for t, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    spans = known or []
                    for _, i, j in auto.runs(words(t)) if t is not None else ():
                        if spans and i <= spans[-1]["j"] <= j:
                            spans[-1] = {"i": min(i, spans[-1]["i"]), "j": j}
                        else:
                            spans.append({"i": i, "j": j})
                    out.append(spans)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, part)], ["k", "t", "spans"])

        return run

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n = 0
                if found:
                    ws, first, end = word_spans(t)
                    spans: list[tuple[int, int]] = []
                    for i, j in sorted((s["i"], s["j"]) for s in found):
                        if spans and i <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(j, spans[-1][1]))
                        else:
                            spans.append((i, j))
                    n, keep, at = sum(j - i for i, j in spans), [], 0
                    for i, j in spans:
                        keep.append(t[at : first[i]])
                        at = end[j - 1]
                    t = None if n > drop_share * len(ws) else "".join([*keep, t[at:]])
                texts.append(t)
                removed.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["k", "clean_text", "removed_words"])

    own, first = pages.select(F.col(key).alias("k"), F.col(text).alias("t"), F.lit(None).cast("array<struct<i:int,j:int>>").alias("spans")), True
    for auto in automata(items, item, item_text, least):
        own = (own if first else stage(own)).mapInArrow(through(pages.sparkSession.sparkContext.broadcast(auto)), schema)
        first = False
    return own.mapInArrow(cut, f"k {kind}, clean_text STRING, removed_words INT").withColumnRenamed("k", key)


def p9_runs(spark, d: str) -> DataFrame:
    return leaked(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet"))


def p9_found(spark, d: str) -> DataFrame:
    return p9_runs(spark, d).select("doc_id", "item_id").distinct()


def p9_cleaned(spark, d: str) -> DataFrame:
    return cleaned(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet"))


QUERIES = {"p9_found": p9_found, "p9_runs": p9_runs, "p9_cleaned": p9_cleaned}
_WORDS = r"""
WITH n AS (SELECT doc_id, list_filter(string_split_regex(strip_accents(replace(lower(text), 'đ', 'd')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
m AS (SELECT item_id, list_filter(string_split_regex(strip_accents(replace(lower(text), 'đ', 'd')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM m WHERE len(w) >= 12)),
h AS (SELECT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM n WHERE len(w) >= 12))
"""
SQL = {"p9_found": _WORDS + "SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (g)"}
