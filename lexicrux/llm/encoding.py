"""Problem 4: text decoded with the wrong encoding, found and restored.

Noisy-channel decoding. A word with characters that Vietnamese text doesn't use is taken as the output of a channel: UTF-8
bytes read as one of CODECS (once or twice over), a legacy font's table (TCVN3, VNI), the letter Ƣ/ƣ standing for Ư/ư, or
letters lost as ? or U+FFFD. For each channel that fits, the word becomes a lattice: a byte lattice in which each letter is
an edge over the bytes that make it, and a lost byte a wildcard that may be any letter's lead, a later byte of one, or a
letter by itself, so that paths of different length compete. Viterbi search goes through the lattice and a tree of all known
words at once and takes the likeliest word under the frequencies counted over both whole tables; a second Viterbi search over
the damaged words of a text takes the likeliest sequence of channels (a channel tends to go on).

A record is found if at least one word can only be explained by such a channel: it decodes to valid text of Vietnamese
letters (byte channels) or to a known word (tables, lost letters or bytes).

A word is known if it makes LEAST_SHARE of all words, and stands there LEAST_COUNT times.

Defined results: null, empty and clean texts have no row; rows repeated are judged each; foreign names, signs and single
misread letters decode to nothing known and are left alone; what can't be restored stays as it is."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicrux.staging import bounded, stage, unstage

#: Known words: their share of all words, and their number, at least. Of a share there can only be so many; Vietnamese has
#: under 20,000 syllables, and a table of more than MOST_WORDS is refused.
LEAST_SHARE, LEAST_COUNT, MOST_WORDS = 4e-8, 3, 1_000_000
#: Cost of another channel than the word before had, of an unknown word, and of a lost byte or letter.
SWITCH, UNKNOWN, LOST_COST = 4.0, 16.0, 2.0
CODECS = ("cp1252", "cp1258", "mac_roman", "cp437", "latin-1", "cp850", "cp1250")

LETTERS = "aàáảãạăằắẳẵặâầấẩẫậeèéẻẽẹêềếểễệiìíỉĩịoòóỏõọôồốổỗộơờớởỡợuùúủũụưừứửữựyỳýỷỹỵđ"
VIETNAMESE = frozenset(LETTERS + LETTERS.upper())
PLAIN = VIETNAMESE | frozenset(chr(i) for i in range(32, 127)) | frozenset("\n\t\r–—“”‘’…•")
TONES = "\0̣̀́̉̃"

# fixed values: the TCVN3 (ABC) font encoding, its code points as Latin-1 characters, each with the letter it stands for
TCVN3_FROM = "µ¸¶·¹¨»¾¼½Æ©ÇÊÈÉËÌÐÎÏÑªÒÕÓÔÖ×ÝØÜÞßãáâä«åèæçé¬êíëìîïóñòô­õøö÷ùúýûüþ®¡¢§£¤¥¦"
TCVN3_TO = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđĂÂĐÊÔƠƯ"
# fixed values: the VNI-Windows encoding: marks written after a base letter, in the order grave, acute, hook, tilde, dot
VNI_PLAIN, VNI_CIRCUMFLEX, VNI_BREVE = "øùûõï", "àáåãä", "èéúüë"
VNI_SINGLE = {"ñ": "đ", "æ": "ỉ", "ó": "ĩ", "ò": "ị", "ö": "ư", "ô": "ơ", "î": "ỵ"}


def _toned(base: str) -> str:
    """The letter with grave, acute, hook, tilde and dot below."""
    i = LETTERS.index(base)
    return LETTERS[i + 1 : i + 6]


def _vni() -> dict[str, str]:
    out = dict(VNI_SINGLE)
    for base in "aeouy":
        out |= {base + m: t for m, t in zip(VNI_PLAIN, _toned(base))}
    for base, hat in zip("aeo", "âêô"):
        out |= {base + "â": hat} | {base + m: t for m, t in zip(VNI_CIRCUMFLEX, _toned(hat))}
    out |= {"aê": "ă"} | {"a" + m: t for m, t in zip(VNI_BREVE, _toned("ă"))}
    for written, letter in (("ô", "ơ"), ("ö", "ư")):
        out |= {written + m: t for m, t in zip(VNI_PLAIN, _toned(letter))}
    return out | {k.upper(): v.upper() for k, v in out.items()}


VNI = _vni()
VNI_RE = re.compile("|".join(sorted(map(re.escape, VNI), key=len, reverse=True)))
TCVN3 = dict(zip(TCVN3_FROM, TCVN3_TO))
TO_BYTE = {}
for _c in CODECS:
    _t = {}
    for _b in range(256):
        try:
            _t.setdefault(bytes([_b]).decode(_c), _b)
        except UnicodeDecodeError:
            _t.setdefault(chr(_b), _b)
    TO_BYTE[_c] = _t
#: Letters and signs a byte lattice may come out at.
TARGETS = {c: c.encode() for c in sorted(VIETNAMESE | set("–—“”‘’…•°²½×§©«»")) if ord(c) > 127}
LEADS = {b[0] for b in TARGETS.values()}
#: Letters by what is known of their bytes (None: lost), for letters of two and three bytes.
BYTES = [(c, e) for c, e in TARGETS.items() if c in VIETNAMESE]
SHOWN = frozenset(c for t in TO_BYTE.values() for c in t)
# whatever reading UTF-8 by one of the codecs can leave of a letter's later bytes; marks a text as worth looking at
ODD = "".join(sorted({c for t in TO_BYTE.values() for c, b in t.items() if 0x80 <= b and c not in PLAIN} | {"ƣ", "Ƣ", "�"} | (set(TCVN3_FROM) - PLAIN) | {c for k in VNI for c in k if c not in PLAIN}))
WORDS = re.compile(r"[^ \t\n\r]+")
LOST = re.compile(r"[^\W\d_]*(?:\?+[^\W\d_]+)+\?*")
#: Marks that may follow or enclose a word; brackets and exclamation marks are left, as scanning makes them of letters.
LIGHT = ".,;:?\"“”"
EDGE = " \t\n\r.,;:!?()[]\"'“”‘’-–"


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n: how often each word of Vietnamese letters stands in the texts (column t), in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            words: Counter = Counter()
            for w, n in total.items():
                w = w.strip(LIGHT).lower()
                if w and VIETNAMESE.issuperset(w) | (w.isascii() and w.isalpha()) or (w.isalpha() and all(c in PLAIN for c in w)):
                    words[w] += n
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    total.update(t.split())
            if len(total) > 400_000:
                yield out()
        yield out()

    return texts.select("t").mapInArrow(run, "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))


#: An edge of a lattice: where it ends, the letters it may stand for, and how many bytes or letters of it are lost.
Edge = tuple[int, tuple[str, ...], int]


@lru_cache(50_000)
def letters_of(part: tuple[int | None, ...], size: int) -> tuple[str, ...]:
    """Letters of so many bytes that what is left of them may stand for: the bytes in order, some lost (None) or missing."""
    out = set()
    for c, e in BYTES:
        if len(e) != size:
            continue
        if len(part) == size:
            fits = all(b is None or b == x for b, x in zip(part, e))
        else:  # bytes were dropped: those left are some of the letter's, in order
            rest = iter(e)
            fits = all(b is None or any(b == x for x in rest) for b in part) and (part[0] is None or part[0] == e[0])
        if fits:
            out.add(c.lower())
    return tuple(sorted(out))


class Decoder:
    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self._ready({w: math.log(n / total) for w, n in counts.items()})

    def _ready(self, log: dict[str, float]) -> None:
        self.log, self.tree = log, None
        self.known, self.lost = lru_cache(200_000)(self._word), lru_cache(100_000)(self.lost_letters)

    def __reduce__(self):
        return _again, (dict(self.log),)

    def probability(self, word: str) -> float | None:
        return self.log.get(word.strip(EDGE).lower())

    def words(self) -> dict:
        """The tree of known words: letter -> node; "" -> log probability of the word that ends here."""
        if self.tree is None:
            self.tree = {}
            for w, p in self.log.items():
                node = self.tree
                for c in w:
                    node = node.setdefault(c, {})
                node[""] = p
        return self.tree

    def likeliest(self, edges: list[list[Edge]]) -> tuple[str, float] | None:
        """Viterbi search for the likeliest known word that goes through the lattice: (word in lower case, log probability)."""
        n = len(edges)
        # for each place the nodes of the tree reached there: node -> (cost, letters so far)
        at: list[dict[int, tuple[float, str, dict]]] = [{} for _ in range(n + 1)]
        root = self.words()
        at[0][id(root)] = (0.0, "", root)
        for i in range(n):
            for cost, text, node in at[i].values():
                for j, letters, lost in edges[i]:
                    more = cost + LOST_COST * lost
                    for c in letters if len(letters) < len(node) else [x for x in node if x in letters]:
                        if (to := node.get(c)) is not None and c and ((old := at[j].get(id(to))) is None or more < old[0]):
                            at[j][id(to)] = (more, text + c, to)
        ends = [(node[""] - cost, text) for cost, text, node in at[n].values() if "" in node]
        return max(((t, p) for p, t in ends), key=lambda x: (x[1], x[0])) if ends else None

    def through(self, edges: list[list[Edge]], shown: list[str]) -> tuple[str, float] | None:
        """The likeliest text of a lattice, with its own marks and capitals; shown: the characters as they stand."""
        edge = EDGE.replace("?", "")
        lo, hi = 0, len(edges)
        while lo < hi and shown[lo] in edge:
            lo += 1
        while hi > lo and shown[hi - 1] in edge:
            hi -= 1
        inside = [[(j - lo, letters, lost) for j, letters, lost in edges[i] if j <= hi] for i in range(lo, hi)]
        if not inside or (best := self.likeliest([[(j, tuple({c.lower() for c in ls}), lost) for j, ls, lost in es] for es in inside])) is None:
            return None
        own = [ls[0] for es in inside for _, ls, lost in es if not lost]
        upper, lower = sum(c.isupper() for c in own), sum(c.islower() for c in own)
        first = inside[0][0][2] > 0  # its first letter is lost
        word = best[0].upper() if upper > lower and (upper > 1 or first) else best[0].capitalize() if own and own[0].isupper() and not first else best[0]
        return "".join(shown[:lo]) + word + "".join(shown[hi:]), best[1]

    @staticmethod
    def byte_lattice(word: str, codec: str) -> tuple[list[list[Edge]], bool, bool] | None:
        """Edges of the byte lattice of a word, whether a letter of several bytes is whole in it, and whether bytes are lost; None if a
        character is no byte."""
        table, data = TO_BYTE[codec], []
        for c in word:
            if c == "\ufffd":
                data.append(None)
            elif (b := table.get(c)) is not None:
                data.append(b)
            else:
                return None
        n = len(data)
        edges: list[list[Edge]] = [[] for _ in range(n)]
        several = lost = False
        for i, b in enumerate(data):
            if b is not None and b < 0x80:
                edges[i].append((i + 1, (chr(b),), 0))
                continue
            if b is not None and b not in LEADS:
                continue  # a later byte, reached by an edge over it
            for size in (2, 3) if b is None else (3,) if b >= 0xE0 else (2,):
                part = tuple(data[i : i + size])
                if len(part) == size and None not in part and all(0x80 <= x < 0xC0 for x in part[1:]):
                    try:
                        c = bytes(part).decode()
                    except UnicodeDecodeError:
                        continue
                    if c in TARGETS:
                        edges[i].append((i + size, (c,), 0))
                        several = True
                    continue
                for k in range(1, size + 1):  # bytes of the letter are lost, as wildcards or, behind its lead, without a trace
                    part = tuple(data[i : i + k])
                    if k < size and b is None or len(part) < k or not all(x is None or 0x80 <= x < 0xC0 for x in part[1:]):
                        continue
                    if letters := letters_of(part, size):
                        edges[i].append((i + k, letters, size - sum(x is not None for x in part)))
                        lost = True
                        several = several or k > 1
        return edges, several, lost

    @staticmethod
    def straight(edges: list[list[Edge]]) -> str | None:
        """The text of a lattice without lost bytes, which has one path."""
        out, i = [], 0
        while i < len(edges):
            here = [e for e in edges[i] if not e[2]]
            if len(here) != 1:
                return None
            out.append(here[0][1][0])
            i = here[0][0]
        return "".join(out) if i == len(edges) else None

    def from_bytes(self, word: str, codec: str) -> tuple[str, float, bool] | None:
        """(text, log probability, whether bytes were lost) of the likeliest path through the byte lattice of a word."""
        if (built := self.byte_lattice(word, codec)) is None or not built[1]:
            return None
        edges, _, lost = built
        if (text := self.straight(edges)) is not None:
            return text, self.probability(text) or -UNKNOWN, False
        if lost and (got := self.through(edges, list(word))) is not None:
            return got[0], got[1], True
        return None

    @staticmethod
    def between(word: str, codec: str) -> str | None:
        """What a word was before it was read by a codec, if that text may itself be the output of a channel: any character
        that a codec can show may come out, and letters whose bytes are lost come out as U+FFFD."""
        table, data = TO_BYTE[codec], []
        for c in word:
            if c == "\ufffd":
                data.append(None)
            elif (b := table.get(c)) is not None:
                data.append(b)
            else:
                return None
        out, i, several = [], 0, False
        while i < len(data):
            b = data[i]
            if b is not None and b < 0x80:
                out.append(chr(b))
                i += 1
                continue
            if b is None or not 0xC2 <= b < 0xF0:
                return None
            size = 3 if b >= 0xE0 else 2
            part = data[i : i + size]
            if len(part) == size and None not in part and all(0x80 <= x < 0xC0 for x in part[1:]):
                try:
                    c = bytes(part).decode()
                except UnicodeDecodeError:
                    return None
                if c not in TARGETS and c not in SHOWN:
                    return None
                out.append(c)
                several = True
                i += size
            else:
                out.append("\ufffd")
                i += len(part) if len(part) < size else 1
        return "".join(out) if several else None

    def _from_bytes(self, word: str) -> list[tuple[str, str, float, bool]]:
        """What the byte channels make of a word: (channel, text, log probability, whether bytes were lost)."""
        out = []
        for codec in CODECS:
            if (got := self.from_bytes(word, codec)) is None:  # read wrongly twice
                if (once := self.between(word, codec)) is not None and once != word:
                    got = next((x for again in CODECS if (x := self.from_bytes(once, again)) is not None), None)
            elif not got[2]:  # valid text may be the output of a first wrong reading as well
                got = next(((x[0], x[1], False) for again in CODECS if (x := self.from_bytes(got[0], again)) is not None), got)
            if got is not None:
                out.append(("utf-8/" + codec, *got))
        return out

    def _word(self, word: str) -> list[tuple[str, str, float]]:
        """(channel, text, log probability) of the channels that explain a damaged word; none: it isn't damaged."""
        # soft hyphen and ¬ are bytes of letters, but also what breaks a word at a line's end
        whole, word = word, word.rstrip("\xad¬")
        tail = whole[len(word) :]
        if tail and ODD_RE.search(word) and (got := [x[:3] for x in self._from_bytes(whole) if not x[3]]):
            return got
        out = []
        odd = ODD_RE.search(word)
        if "ƣ" in word or "Ƣ" in word:
            text = word.replace("ƣ", "ư").replace("Ƣ", "Ư")
            out.append(("oi", text, self.probability(text) or -UNKNOWN))
        if odd:
            out += [x[:3] for x in self._from_bytes(word)]
            body = word.strip(EDGE)
            if not out and len(body) > 1 and any(c not in PLAIN for c in body) and sum(c.isdigit() for c in body) == 0:
                for name, text in (("tcvn3", "".join(TCVN3.get(c, c) for c in body)), ("vni", VNI_RE.sub(lambda m: VNI[m[0]], body))):
                    if text != body and (p := self.log.get(text.lower())) is not None:
                        out.append((name, word.replace(body, text if not body.isupper() and sum(c.isupper() for c in body) * 2 < len(body) else text.upper()), p))
            if "\ufffd" in word and (got := self._letters(word)):
                out.append(("lost", *got))
            if not out and "\ufffd" in word:
                out.append(("lost", word, -UNKNOWN))
        return [(c, t + tail, p) for c, t, p in out]

    def lost_letters(self, word: str) -> str | None:
        """A word in which ? or U+FFFD stand for lost letters: the likeliest known word through a lattice of letters."""
        got = self._letters(word)
        return got and got[0]

    def _letters(self, word: str) -> tuple[str, float] | None:
        return self.through([[(i + 1, LETTERS_LOST, 1)] if c in "?\ufffd" else [(i + 1, (c,), 0)] for i, c in enumerate(word)], list(word))

    def evidence(self, text: str) -> list[tuple[int, int, str, str]]:
        """(first, end, channel, restored) of the words that only a channel explains: the likeliest sequence of channels."""
        found = []
        if ODD_ONLY.search(text) or LED_ONLY.search(text):
            for m in ODD_WORD.finditer(text):
                if got := self.known(m[0]):
                    found.append((m.start(), m.end(), got))
        out, least, back = [], {}, []
        for a, b, options in found:  # Viterbi over the channels of the damaged words
            new, come = {}, {}
            low = min(least.values(), default=0.0)
            for channel, t, p in options:
                stay = least.get(channel, math.inf)
                before = min(stay, low + (SWITCH if least else 0.0))
                if (cost := before - p) < new.get(channel, (math.inf, ""))[0]:
                    new[channel] = (cost, t)
                    come[channel] = channel if stay <= before and least else min(least, key=lambda c: (least[c], c), default="")
            least = {c: x[0] for c, x in new.items()}
            back.append((new, come))
        if back:
            channel = min(least, key=lambda c: (least[c], c))
            for (a, b, _), (new, come) in zip(reversed(found), reversed(back)):
                out.append((a, b, channel, new[channel][1]))
                channel = come[channel]
            out.reverse()
        if "?" in text:
            hits = [(m, w) for m in LOST.finditer(text) if "?" in m[0].rstrip("?") and (w := self.lost(m[0].rstrip("?"))) is not None]
            out += [(m.start(), m.start() + len(m[0].rstrip("?")), "lost", w) for m, w in hits]
        return out

    def restore(self, text: str) -> str:
        """Viterbi over the words: each is clean or went through one of the channels seen in the text."""
        found = self.evidence(text)
        if not found:
            return text
        tables = sorted({c for _, _, c, _ in found if c in ("tcvn3", "vni")})
        fixed = {a: (b, w) for a, b, _, w in found}
        if sum(c == "lost" for _, _, c, _ in found) >= 3:  # letters are lost at the ends of words as well
            for m in re.finditer(r"[^\W\d_?]*\?[^\W\d_]*\??", text):
                if m.start() not in fixed and len(m[0]) > 1 and (w := self.lost(m[0])) is not None:
                    fixed[m.start()] = (m.end(), w)
        words = [(m.start(), m.end()) for m in WORDS.finditer(text)]
        states = ["clean", *tables]
        cost = [0.0] + [4.0] * len(tables)
        back: list[list[int]] = []
        options: list[list[str]] = []
        for a, b in words:
            w = text[a:b]
            row = [w]
            for t in tables:
                x = "".join(TCVN3.get(c, c) for c in w) if t == "tcvn3" else VNI_RE.sub(lambda m: VNI[m[0]], w)
                # the font's capitals share the small letters' codes
                row.append(x.upper() if sum(c.isupper() for c in x) * 2 >= sum(c.isalpha() for c in x) > 1 else x)
            odd = any(c not in PLAIN for c in w)
            emit = [-(self.probability(x) or (-18.0 if odd and i == 0 else -14.0)) for i, x in enumerate(row)]
            step, new = [], []
            for i in range(len(states)):
                j = min(range(len(states)), key=lambda j: cost[j] + (0.0 if i == j else 4.0))
                step.append(j)
                new.append(cost[j] + (0.0 if i == j else 4.0) + emit[i])
            cost = new
            back.append(step)
            options.append(row)
        state = min(range(len(states)), key=cost.__getitem__)
        chosen = []
        for step, row in zip(reversed(back), reversed(options)):
            chosen.append(row[state])
            state = step[state]
        chosen.reverse()
        out, at = [], 0
        for (a, b), w in zip(words, chosen):
            out.append(text[at:a])
            inside = [(x, fixed[x]) for x in range(a, b) if x in fixed]
            if w == text[a:b] and inside:
                k = a
                parts = []
                for x, (e, r) in inside:
                    parts += [text[k:x], r]
                    k = e
                w = "".join(parts) + text[k:b]
            out.append(w)
            at = b
        return "".join(out) + text[at:]


LETTERS_LOST = tuple(c for c in LETTERS if ord(c) > 127)
ODD_CLASS = "[" + re.escape(ODD) + "]"
# a letter that leads two or three bytes, before a sign that stands for a later byte, though both are at home in the text
LED = "[ÃÂĂ][‘’“”–—…•]"
ODD_ONLY, LED_ONLY = re.compile(ODD_CLASS), re.compile(LED)
ODD_RE = re.compile(f"{ODD_CLASS}|{LED}")
ODD_WORD = re.compile(rf"[^ \t\n\r]*(?:{ODD_CLASS}|{LED})[^ \t\n\r]*")


def _again(log: dict[str, float]) -> Decoder:
    d = Decoder({})
    d._ready(log)
    return d


def fields(spark, d: str) -> DataFrame:
    """tbl, k, t: the texts of both tables."""
    one = lambda name, key, text: spark.read.parquet(f"{d}/{name}.parquet").select(F.lit(name).alias("tbl"), F.col(key).alias("k"), F.col(text).alias("t"))
    return one("precedents", "rec_no", "full_text").unionByName(one("ocr_results", "ocr_id", "text")).where("t IS NOT NULL")


def fitted(texts: DataFrame) -> Decoder:
    counts = stage(word_counts(texts))
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = counts.where(F.col("n") >= max(LEAST_COUNT, LEAST_SHARE * total))
    out = Decoder({r.word: r.n for r in bounded(known, MOST_WORDS, "the known words")})
    unstage(counts)
    return out


def damaged(texts: DataFrame, restore: bool = False) -> DataFrame:
    """tbl, k, words (number of damaged words), channels, and the restored text where asked for."""
    sent = texts.sparkSession.sparkContext.broadcast(fitted(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = sent.value
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column(2).to_pylist()):
                if found := dec.evidence(t):
                    rows.append((i, len(found), sorted({c for _, _, c, _ in found}), dec.restore(t) if restore else None))
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.string())],
                ["tbl", "k", "words", "channels", "restored"],
            )

    return texts.mapInArrow(run, "tbl STRING, k BIGINT, words INT, channels ARRAY<STRING>, restored STRING")


def p4_found(spark, d: str) -> DataFrame:
    return damaged(fields(spark, d)).select("tbl", F.col("k").alias("row_key"))


def p4_restored(spark, d: str) -> DataFrame:
    return damaged(fields(spark, d), restore=True).select("tbl", F.col("k").alias("row_key"), "words", "channels", "restored")


QUERIES = {"p4_found": p4_found, "p4_restored": p4_restored}
SQL: dict[str, str] = {}
