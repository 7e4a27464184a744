"""Problem 10: pages built of keywords, links, tags or goods lines.

A page becomes a sequence of function words, frequent words and word classes (number, initials, address, tag, capitalised,
other, with the place inside a run of such words). An n-gram model (word pairs and pairs with one word between them,
smoothed by single words) is trained on the sentences and numbered list lines of all pages: which words are frequent, the
model's counts and the limits below are counted over the whole table, in tables of fixed size that are added up.

Pages are scored in segments of about SEGMENT words that follow their lines. A segment is stuffing if its perplexity is

- abnormally high: above median + SPREAD times the distance from there to the 90 % quantile of all training prose, or
- abnormally low: a cache of the segment's own word pairs, mixed into the model, takes more off its log perplexity than
  off training prose, by the same rule and by LEAST_GAIN at least. That is how a page that repeats itself shows.

A page is found if most of its words (SHARE) stand in such segments.

Defined results: null, empty and blank pages are never found; repeated rows are judged each; with an empty table, or one
without any prose, nothing is found. Whole texts are scored."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicrux.staging import bounded, stage

SEGMENT = 24
FREQUENT = 400
SPREAD = 3.5
LEAST_GAIN = 1.0
CACHE = 0.5
#: More than a half, as a segment counts whole and odd sentences count as well.
SHARE = 0.65
#: Cells of a histogram of scores, and their width.
CELLS, WIDTH = 4000, 0.005
PAGES = 512

# fixed values: function words of Vietnamese and English
FUNCTION_WORDS = """
và của là có được cho tại không trong thì với các những một này đó khi nếu để từ đến do bị theo như về người mà nên nhưng
hoặc hay cũng đã đang sẽ rất vì bởi ra vào lên xuống trên dưới trước sau giữa cùng còn chỉ đều mỗi mọi nhiều ít rằng thấy
lại đi tôi bạn ông bà anh chị họ ai gì nào đâu sao bằng nhằm dù tuy vẫn chưa phải cần nơi lúc hồi ngày tháng năm giờ phút
thuộc đối nhau nó chúng ta mình kể
the of and to in a that was were is are by on for with as at from had has have not be been it this which but or an its
their his her under before after between
""".split()
SIGNS = list(".,;:?!|-–—/\"“”()[]<>#»•*&%='")
SHAPES = ["url", "tag", "markup", "initials", "number", "capitals", "sign", "line"]
WORD_RUN, NAME_RUN = 14, 6
TOKEN = re.compile(r"https?://\S+|www\.\S+|#\w+|<a\b|</a>|(?:\w\.)+\w\b|\d(?:[\d.,/:\-]*\d)?\w*|\w+|[^\w\s]|\n")
#: Words of a sentence that the model learns from, and the function words a list line must hold.
SENTENCE, LISTED = (6, 150), 2


class Prose:
    """Classes of tokens, and smoothed tables of negative log probabilities once they are counted."""

    def __init__(self, frequent: list[str]):
        names = dict.fromkeys([*FUNCTION_WORDS, *frequent, *SIGNS])
        self.ids = {w: i for i, w in enumerate(names, 1)}
        n = len(self.ids) + 1
        self.shape = {s: n + i for i, s in enumerate(SHAPES)}
        self.word = n + len(SHAPES)
        self.name = self.word + WORD_RUN
        self.size = self.name + NAME_RUN
        self._tables()

    def _tables(self) -> None:
        kind = np.zeros(self.size, np.uint8)  # 1: ends a sentence, 2: ends a line, 4: not in prose, 8: function word, 16: opens a sentence
        for signs, bit in ((".?!", 1), ("#|<>»–•", 4)):
            for c in signs:
                kind[self.ids[c]] |= bit
        kind[self.shape["line"]] |= 2
        for s in ("url", "tag", "markup"):
            kind[self.shape[s]] |= 4
        kind[[self.ids[w] for w in FUNCTION_WORDS]] |= 8
        self.kind = kind
        self.cache = _Known(self)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cache"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.cache = _Known(self)

    def counted(self, pair: np.ndarray, skip: np.ndarray) -> "Prose":
        one = (pair.sum(0) + 0.5) / (pair.sum() + 0.5 * self.size)
        self.pair, self.skip = (np.minimum(-np.log((m + 3 * one) / (m.sum(1, keepdims=True) + 3)), 10).astype(np.float32) for m in (pair, skip))
        return self

    def classed(self, t: str) -> int:
        low = t.lower()
        if low in self.ids:
            return self.ids[low]
        c = t[0]
        if c == "\n":
            return self.shape["line"]
        if c == "#":
            return self.shape["tag"]
        if c == "<":
            return self.shape["markup"]
        if c.isdigit():
            return self.shape["number"]
        if "://" in t or t[:4] == "www.":
            return self.shape["url"]
        if "." in t:
            return self.shape["initials"]
        if not c.isalpha():
            return self.shape["sign"]
        if len(t) > 1 and t.isupper():
            return self.shape["capitals"]
        return self.name if c.isupper() else self.word

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class, identity and whether it begins with a capital, of all tokens of some pages, and the first token of each page
        (and the end of the last). Stretches between blanks are told apart by Arrow; only different ones come to Python."""
        if len(self.cache) > 300_000:
            self.cache.clear()
        parts = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " \n "), " ")
        coded = parts.flatten().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        rows = list(map(self.cache.__getitem__, coded.dictionary.to_pylist()))
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        values = np.fromiter(chain.from_iterable(rows), np.int64, int(n.sum()))
        many = n[at]
        until = np.cumsum(many)
        a = values[np.repeat((np.cumsum(n) - n)[at] - (until - many), many) + np.arange(until[-1] if len(until) else 0)]
        chunks = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])
        page = np.concatenate([[0], until])[chunks]
        cls, word, capital = (a & 0xFFFF).astype(np.int32), a >> 17, (a >> 16 & 1).astype(bool)
        at = np.arange(len(a))
        for base, most in ((self.word, WORD_RUN), (self.name, NAME_RUN)):
            m = cls == base
            if m.any():
                last = np.where(m, -1, at)
                last[page[:-1][page[:-1] < len(a)]] = np.maximum(last[page[:-1][page[:-1] < len(a)]], page[:-1][page[:-1] < len(a)] - 1)
                place = at - np.maximum.accumulate(last) - 1
                cls = np.where(m, base + np.minimum(place, most - 1), cls)
        return cls, word, capital, page

    def prose(self, cls: np.ndarray, capital: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sentences and list lines of the pages: the tokens the model learns from, and which of these are a sentence's first."""
        if not len(cls):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        n, kind, line = len(cls), self.kind[cls], self.shape["line"]
        closing = np.zeros(n, bool)  # the last token of a page
        closing[page[1:][page[1:] > 0] - 1] = True
        breaks = (kind & 2 > 0) | closing
        # a mark at the line's end ends a sentence, and one before a capital; the number of a list line, `Điều 1.`, opens what follows
        opens = np.concatenate([[True, True], breaks])  # opens[i + 1]: token i begins a line
        listed = (np.concatenate([[-1], cls[:-1]]) == self.shape["number"]) & (opens[:-2] | np.concatenate([[True], opens[:-3]]))
        ends = breaks | ((kind & 1 > 0) & (np.concatenate([cls[1:] == line, [True]]) | np.concatenate([capital[1:], [True]])) & ~listed)
        last = np.flatnonzero(ends)
        first = np.concatenate([[0], last[:-1] + 1])
        bad = np.add.reduceat(kind & 4, first)
        function = np.add.reduceat((kind & 8 > 0).astype(np.int32), first)
        closed = kind[last] & 1 > 0
        length = last - first + (cls[last] != line)
        number = (cls[first] == self.shape["number"]) | (cls[np.minimum(first + 1, n - 1)] == self.shape["number"])
        good = (bad == 0) & (function > 0) & (length >= SENTENCE[0]) & (length <= SENTENCE[1]) & ((closed & capital[first]) | ((function >= LISTED) & number))
        keep = np.repeat(good, last - first + 1) & (cls != line)
        begins = np.zeros(n, bool)
        begins[first] = True
        at = np.flatnonzero(keep)
        return at, begins[at]

    @staticmethod
    def context(cls: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes one and two places before each token, 0 before a beginning."""
        one = np.concatenate([[0], cls[:-1]])
        two = np.concatenate([[0, 0], cls[:-2]])[: len(cls)]
        one[begins] = 0
        two[begins | np.concatenate([[True], begins[:-1]])] = 0
        return one, two

    def measured(self, cls: np.ndarray, word: np.ndarray, begins: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the segments that begin at `first`: mean score, what the cache takes off it, and length."""
        length = np.diff(np.concatenate([first, [len(cls)]]))
        one, two = self.context(cls, begins)
        score = self.pair[one, cls] + self.skip[two, cls]
        where = np.repeat(np.arange(len(first), dtype=np.int64), length) * 0x1F123BB5
        before = np.concatenate([[0], word[:-1]])
        before[first] = 0
        seen, of = _earlier((before * 0x9E3779B1 ^ word) * 0x85EBCA77 + where), _earlier(before * 0x9E3779B1 + where)
        gain = np.zeros(len(cls), np.float32)
        at = np.flatnonzero(seen)
        cached = -np.log(CACHE * seen[at] / (of[at] + 1) + (1 - CACHE) * np.exp(-score[at]))
        gain[at] = np.maximum(score[at] - cached, 0)
        return np.add.reduceat(score, first) / length, np.add.reduceat(gain, first) / length, length

    def segments(self, cls: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First tokens of the segments of all pages, and how many each page has: lines put together up to SEGMENT words,
        longer ones cut evenly."""
        edges = np.flatnonzero(cls == self.shape["line"]) + 1
        out, many = [], []
        for lo, hi in zip(page[:-1].tolist(), page[1:].tolist()):
            own, at = [lo], lo
            for e in [*edges[np.searchsorted(edges, lo, "right") : np.searchsorted(edges, hi, "left")].tolist(), hi]:
                if e - at >= SEGMENT or e == hi:
                    k = max(1, round((e - at) / SEGMENT))
                    own += [at + (e - at) * i // k for i in range(1, k)] + [e]
                    at = e
            if len(own) > 2 and hi - own[-2] < SEGMENT // 2:  # a short rest belongs to what is before it
                del own[-2]
            out += own[:-1]
            many.append(len(own) - 1)
        return np.array(out, np.int64), np.array(many, np.int64)


class _Known(dict):
    """Tokens of each stretch without blanks: class, whether it begins with a capital, and identity in one number each."""

    def __init__(self, model: Prose):
        super().__init__()
        self.model = model

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if chunk.isdigit():
            out = ((hash(chunk) & 0x3FFFFFFFFFFF) << 17 | self.model.shape["number"],)
        else:
            out = tuple((hash(t) & 0x3FFFFFFFFFFF) << 17 | t[0].isupper() << 16 | self.model.classed(t) for t in TOKEN.findall(chunk))
        self[chunk] = out
        return out


def _earlier(key: np.ndarray) -> np.ndarray:
    """How often each element stood there before."""
    n = len(key)
    bits = max(1, n.bit_length())
    packed = np.sort((key << bits) | np.arange(n))  # sorted with their places; the bits lost are those of a hash
    order, s = packed & ((1 << bits) - 1), packed >> bits
    new = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.arange(n)
    out = np.empty(n, np.float32)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def frequent(pages: DataFrame) -> list[str]:
    """The FREQUENT words that stand in most pages (column t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            words: Counter = Counter()
            for w, n in total.items():
                w = w.strip(".,;:?!()\"“”").lower()
                if w.isalpha():
                    words[w] += n
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                total.update(set(t.split()))
            if len(total) > 400_000:
                yield out()
        yield out()

    counts = pages.select("t").mapInArrow(run, "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]


def _blocks(col: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Pages of a batch, some at a time: the first one's place, and the texts."""
    for lo in range(0, len(col), PAGES):
        yield lo, col.slice(lo, PAGES)


def counted(pages: DataFrame, model: Prose) -> Prose:
    """The model with its word pairs counted over all pages."""
    sent = pages.sparkSession.sparkContext.broadcast(model)
    n = model.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = sent.value, np.zeros(2 * n * n, np.int64)
        for batch in batches:
            for _, texts in _blocks(batch.column(0)):
                cls, _, capital, page = m.tokens(texts)
                at, begins = m.prose(cls, capital, page)
                if len(at):
                    own = cls[at].astype(np.int64)
                    one, two = m.context(own, begins)
                    table += np.bincount(np.concatenate([one * n + own, n * n + two * n + own]), minlength=2 * n * n)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(table[at], pa.int64())], ["at", "n"])

    rows = pages.select("t").mapInArrow(run, "at INT, n BIGINT").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    both = np.zeros(2 * n * n)
    both[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return model.counted(*both.reshape(2, n, n))


def measured(pages: DataFrame, model: Prose) -> DataFrame:
    """Of each page (k, t) its segments (mean score, gain, words); and rows without a page that count the scores of the
    training prose: at (cell of the histogram), n."""
    sent = pages.sparkSession.sparkContext.broadcast(model)
    kind = dict(pages.dtypes)["k"]
    part = pa.list_(pa.struct([("mean", pa.float32()), ("gain", pa.float32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cells, own = sent.value, np.zeros(2 * CELLS, np.int64), None
        for batch in batches:
            own = batch.column(0).type
            for lo, texts in _blocks(batch.column(1)):
                cls, word, capital, page = m.tokens(texts)
                first, many = m.segments(cls, page) if len(cls) else (np.zeros(0, np.int64), np.zeros(len(texts), np.int64))
                if len(first):
                    begins = np.zeros(len(cls), bool)
                    begins[page[:-1][page[:-1] < len(cls)]] = True
                    mean, gain, length = m.measured(cls, word, begins, first)
                    at, begins = m.prose(cls, capital, page)
                    if len(at):
                        start = np.flatnonzero(begins)
                        size = np.diff(np.concatenate([start, [len(at)]]))
                        k = np.maximum(1, np.round(size / SEGMENT).astype(np.int64))
                        nth = (np.arange(len(at)) - np.repeat(start, size)) * np.repeat(k, size) // np.repeat(size, size)
                        turn = np.flatnonzero(begins | (np.diff(nth, prepend=-1) != 0))
                        for x, base in zip(m.measured(cls[at], word[at], begins, turn)[:2], (0, CELLS)):
                            cells += np.bincount(base + np.minimum((x / WIDTH).astype(np.int64), CELLS - 1), minlength=2 * CELLS)
                else:
                    mean = gain = length = np.zeros(0)
                flat = pa.StructArray.from_arrays([pa.array(mean, pa.float32()), pa.array(gain, pa.float32()), pa.array(length, pa.int32())], ["mean", "gain", "words"])
                rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), flat)
                empty = pa.nulls(len(texts), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, PAGES), rows, empty, empty.cast(pa.int64())], ["k", "parts", "at", "n"])
        if own is not None:
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), own), pa.nulls(len(at), part), pa.array(at, pa.int32()), pa.array(cells[at], pa.int64())], ["k", "parts", "at", "n"])

    return pages.select("k", "t").mapInArrow(run, f"k {kind}, parts ARRAY<STRUCT<mean: FLOAT, gain: FLOAT, words: INT>>, at INT, n BIGINT")


def _limit(cells: np.ndarray) -> float:
    """Median and 90 % quantile of a histogram, and what lies beyond them by SPREAD."""
    total = np.cumsum(cells)
    mid, high = ((np.searchsorted(total, q * total[-1]) + 0.5) * WIDTH for q in (0.5, 0.9))
    # prose all of one kind has hardly any spread; twice its usual score is still nothing strange
    return float(max(mid + SPREAD * (high - mid), 2 * mid))


def stuffed(pages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the share of its words that stand in stuffing, for every page that has words."""
    own = pages.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike(r"\S"))
    scored = stage(measured(own, counted(own, Prose(frequent(own)))))
    cells = np.zeros(2 * CELLS, np.int64)
    for r in bounded(scored.where("at IS NOT NULL").groupBy("at").agg(F.sum("n").alias("n")), 2 * CELLS, "the cells"):
        cells[r["at"]] = r["n"]
    high, low = (_limit(cells[:CELLS]), max(LEAST_GAIN, _limit(cells[CELLS:]))) if cells.any() else (float("inf"), float("inf"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["words"])
    bad = F.filter("parts", lambda x: (x["mean"] > high) | ((x["gain"] > low) & (x["words"] >= SEGMENT // 2)))
    return scored.where("at IS NULL AND size(parts) > 0").select(F.col("k").alias(key), (total(bad) / total(F.col("parts"))).alias("stuffing"))


def p10_scores(spark, d: str) -> DataFrame:
    return stuffed(spark.read.parquet(f"{d}/documents.parquet"))


def p10_found(spark, d: str) -> DataFrame:
    return p10_scores(spark, d).where(F.col("stuffing") > SHARE).select("doc_id")


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores}
SQL: dict[str, str] = {}
