"""Problem 5: traces of page and line in texts of scanned pages, found and repaired.

An averaged-perceptron editor decides at every doubtful character: keep, replace by a letter, delete, insert a space, or join
the lines. Doubtful are digits and marks among letters, break marks at line ends, line ends themselves, and places inside an
unknown word at which two known words meet. Only replaced characters count as misread. A second averaged
perceptron decides which lines are page furniture, from their form and from where they stand (place in the text, repetition
of their form, how the neighbouring lines go on): lines whose form is there again, lines that stand inside a sentence, and
short lines with a number are asked about. Both are trained on a bounded sample (SAMPLE texts, least by hash; of these the
WORDS most frequent words, and ALIKE tokens of each form): known
words and lines of the sample, damaged by the noise model below (letters misread, marks strewn in, blanks lost, words and
paragraphs broken), against the sample's own words, codes, amounts and lines.
Word frequencies are counted over both whole tables.

Defined results: null and empty texts have no row; texts decoded wrongly (problem 4) have none; rows repeated are judged
each; a text of one line can be `misread` only. In an empty table nothing is trained and nothing found."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicrux.llm.encoding import EDGE, LETTERS, Decoder, fields, fitted

SAMPLE = 400
WORDS, ALIKE = 2000, 20
LEAST_MISREAD = 3
# fixed values: what scanning makes of letters
CONFUSIONS = {
    "o": "0", "i": "1!|", "l": "1|", "t": "†", "b": "6", "s": "5", "c": "(", "g": "9", "ê": "€", "ô": "60", "z": "2", "e": "€", "a": "4@", "q": "9", "ơ": "0", "õ": "0", "ó": "6", "ò": "0", "ọ": "0", "ỏ": "0", "ì": "1", "í": "1", "ị": "!", "ỉ": "1",
}
TONED = {"à": "a`", "á": "a'", "è": "e`", "é": "e'", "ì": "i`", "í": "i'", "ò": "o`", "ó": "o'", "ù": "u`", "ú": "u'"}
MARKS = "†(|!€'`@"
BREAKS = "-\xad¬‐"
LETTER = f"[{LETTERS}{LETTERS.upper()}bcdđghklmnpqrstvxfjwzBCDĐGHKLMNPQRSTVXFJWZ]"
# a digit that stands alone, or a mark, with a letter beside it
DOUBT = re.compile(rf"(?:(?<={LETTER})|(?<![^\s\"“]))(?:(?<![\d./,-])\d(?![\d.,/-]*\d)|[{MARKS}])(?={LETTER})|(?<={LETTER})(?:\d(?!\d)|[{MARKS}])")
AT_END = re.compile(rf"((?:{LETTER}|[\d{MARKS}])+)( ?)([{BREAKS}])[ \t]*\n[ \t]*((?:{LETTER}|[\d{MARKS}])+)")
BROKEN = re.compile(rf"[{BREAKS}][ \t]*\n")
TOKEN = re.compile(r"\S+")
CASE = re.compile(r"[\dOoIl|]{1,4}/[\dOoIl|]{4}/\S+")
NUMBERED = re.compile(r"\d|(?<!\w)[OIl|]+(?!\w)")
NOT_LETTERS, NOT_DIGITS = re.compile(r"[\W\d_]+"), re.compile(r"\D+")
SHAPED, LETTERED = re.compile(r"[\dOIl|]+(?=[\d/OIl| .\]\-–]|$)"), re.compile(r"[^\W\d_]+")
SENTENCE_END = (".", ";", ":", "?", "!", "…")
VOWEL = re.compile("[" + "".join(c for c in LETTERS if c != "đ") + "]", re.I)
WIDE = 130
MASKED = str.maketrans("123456789", "000000000")


class Perceptron:
    """Averaged perceptron over binary features."""

    def __init__(self):
        self.w: dict[str, dict[str, float]] = {}

    def best(self, features: list[str], allowed: list[str]) -> str:
        score = dict.fromkeys(allowed, 0.0)
        for f in features:
            if (ws := self.w.get(f)) is not None:
                for c, v in ws.items():
                    if c in score:
                        score[c] += v
        return max(allowed, key=lambda c: (score[c], -allowed.index(c)))

    def fit(self, examples: list[tuple[list[str], list[str], str]], rounds: int = 4) -> "Perceptron":
        rng, now, total, stamp, n = random.Random(3), defaultdict(lambda: defaultdict(float)), defaultdict(float), defaultdict(int), 0
        self.w = now
        examples = list(examples)
        for _ in range(rounds):
            rng.shuffle(examples)
            for features, allowed, right in examples:
                n += 1
                guess = self.best(features, allowed)
                if guess != right:
                    for f in features:
                        for c, d in ((right, 1.0), (guess, -1.0)):
                            total[f, c] += (n - stamp[f, c]) * now[f][c]
                            stamp[f, c] = n
                            now[f][c] += d
        mean: dict[str, dict[str, float]] = {}
        for f, ws in now.items():
            for c, v in ws.items():
                if a := (total[f, c] + (n - stamp[f, c]) * v) / max(1, n):
                    mean.setdefault(f, {})[c] = a
        self.w = mean
        return self

    def also(self, examples: list[tuple[list[str], list[str], str]]) -> "Perceptron":
        """Fitted to further examples, none of whose features is known yet."""
        self.w |= Perceptron().fit(examples).w
        return self


def damaged(word: str, rng: random.Random) -> tuple[str, int, str, str]:
    """A word with one letter misread: (written, place, what stands there, operation)."""
    places = [i for i, c in enumerate(word) if c.lower() in CONFUSIONS or c.lower() in TONED]
    i = rng.choice(places)
    low = word[i].lower()
    if low in TONED and (low not in CONFUSIONS or rng.random() < 0.5):
        return word[:i] + TONED[low] + word[i + 1 :], i + 1, TONED[low][1], "tone"
    sign = rng.choice(CONFUSIONS[low])
    return word[:i] + sign + word[i + 1 :], i, sign, "put:" + low


def narrowed(line: str, width: int) -> list[str]:
    """The line in rows of at most so many characters."""
    row, out = "", []
    for w in line.split(" "):
        if row and len(row) + 1 + len(w) > width:
            out.append(row)
            row = w
        else:
            row = f"{row} {w}" if row else w
    return [*out, row]


class Editor:
    def __init__(self, decoder: Decoder, texts: list[str]):
        self.decoder, self.log = decoder, decoder.log
        rng = random.Random(11)
        clean = [t for t in texts if not decoder.evidence(t)]
        own = random.Random(5)
        chars = self._char_examples(clean, rng) if clean else []
        # one table of weights; the kinds of places share no feature, so that each is averaged over its own examples
        self.chars = Perceptron().fit(chars + self._stray_examples(own)).also(self._gap_examples(own)).also(self._break_examples(clean, own)).also(self._end_examples(clean, own)) if clean else None
        self.lines = Perceptron().fit(self._line_examples(clean, rng)) if clean else None
        self.seen: dict[str, int] = {}
        self.fixed: dict[str, str] = {}
        self.last: tuple[str, list[int]] = ("", [])

    # the character editor ------------------------------------------------------------------------------------------------

    def known(self, w: str) -> bool:
        return w.lower() in self.log

    def char_features(self, token: str, i: int) -> tuple[list[str], list[str]]:
        """Features of a doubtful character, and the operations open to it."""
        c, low = token[i], token.lower()
        before, after = low[i - 1 : i] or "^", low[i + 1 : i + 2] or "$"
        options = ["keep"]
        core = token.strip(EDGE)
        opened = c in "([" and self.known(token[i + 1 :].strip(EDGE)) or c in "!?)'`" and self.known(token[:i].strip(EDGE))
        best = None
        for letter, signs in CONFUSIONS.items():
            if c in signs:
                options.append("put:" + letter)
                p = self.log.get((low[:i] + letter + low[i + 1 :]).strip(EDGE))
                if p is not None and (best is None or p > best[0]):
                    best = (p, letter)
        if c in "'`" and before in "aeiou":
            options.append("tone")
            if self.known((low[: i - 1] + next(k for k, v in TONED.items() if v == before + c) + low[i + 1 :]).strip(EDGE)):
                best = (0.0, "tone")
        stray = c in MARKS and before.isalpha() and after.isalpha() and self.known((low[:i] + low[i + 1 :]).strip(EDGE))
        if stray:
            options.append("delete")
        digits = sum(x.isdigit() for x in core)
        f = [
            f"c={c}", f"b={before}", f"a={after}", f"bc={before}{c}", f"ca={c}{after}",
            f"bl={before.isalpha()},al={after.isalpha()},{c.isdigit()}", f"digits={min(digits, 3)},{c.isdigit()}",
            f"code={'/' in core or '-' in core or core.count('.') > 0}", f"open={bool(opened)}", f"upper={core.isupper()},{c.isdigit()}",
            f"known={best[1] if best else None},{c}", f"isknown={best is not None},{bool(opened)}", f"length={min(len(core), 4)}", f"unit={after == '$' or before == '^'},{best is not None}",
        ]
        if best:
            f.append(f"{c}>{best[1]}")
        if stray:
            f += [f"stray={best is not None}", f"stray={c},{best is not None}"]
        return f, options

    def _char_examples(self, texts: list[str], rng: random.Random) -> list:
        out = []
        words = [w for w in self.log if any(c in CONFUSIONS or c in TONED for c in w) and len(w) > 1]
        words = sorted(words, key=lambda w: (-self.log[w], w))[:WORDS]
        for w in words:
            for _ in range(3):
                shown = w if rng.random() < 0.8 else w.capitalize() if rng.random() < 0.5 else w.upper()
                written, i, _, op = damaged(shown, rng)
                f, options = self.char_features(written, i)
                if op in options:
                    out.append((f, options, op))
        taken: Counter = Counter()
        for t in texts:
            for tok in TOKEN.findall(t):
                if not tok.isalpha() and (m := DOUBT.search(tok)):
                    core = tok.strip(EDGE + "(")
                    # codes, amounts, plates, words in brackets: what scanning didn't do
                    if sum(c.isdigit() for c in core) > 1 or "/" in core or self.known(core):
                        shape = re.sub(r"\d", "0", tok)
                        taken[shape] += 1
                        if taken[shape] <= ALIKE:
                            f, options = self.char_features(tok, m.start())
                            out.append((f, options, "keep"))
        for w in rng.sample(words, min(300, len(words))):
            for tok, i in ((f"({w}", 0), (f"{w}!", len(w)), (f"({w})", 0), (f"'{w}'", len(w) + 1), (f"{w}'", len(w)), (f"|{w}", 0)):
                f, options = self.char_features(tok, i)
                out.append((f, options, "keep"))
        for unit in ("m", "ha", "kg", "h", "km", "đ", "a", "b", "c", "cm", "g"):
            for n in "12345678":
                f, options = self.char_features(n + unit, 0)
                out.append((f, options, "keep"))
        return out

    def words(self) -> list[str]:
        """The most frequent words of two letters or more with a vowel."""
        return sorted((w for w in self.log if len(w) > 1 and VOWEL.search(w)), key=lambda w: (-self.log[w], w))[:WORDS]

    @staticmethod
    def shown(word: str, rng: random.Random) -> str:
        return word if rng.random() < 0.7 else word.capitalize() if rng.random() < 0.6 else word.upper()

    def _stray_examples(self, rng: random.Random) -> list:
        """Words with a mark strewn in; few, as most marks stand for a letter."""
        out = []
        for w in self.words()[:400]:
            i = rng.randint(1, len(w) - 1)
            f, options = self.char_features(w[:i] + rng.choice(MARKS) + w[i:], i)
            if "delete" in options and "isknown=False,False" in f:
                out.append((f, options, "delete"))
        return out

    def _rank(self, word: str) -> int:
        """How rare a word is: 0 to 8, 9 for an unknown one."""
        return 9 if (p := self.log.get(word.lower())) is None else min(8, int(-p))

    def gap_features(self, word: str, i: int) -> list[str]:
        """Features of a place in an unknown word at which a blank may be lost."""
        left, right = word[:i], word[i:]
        a, b = self._rank(left), self._rank(right)
        vowels = f"{VOWEL.search(left) is not None},{VOWEL.search(right) is not None}"
        return [f"g:vowels={vowels}", f"g:rare={max(a, b)},{vowels}", f"g:left={a}", f"g:right={b}", f"g:size={min(len(left), 4)},{min(len(right), 4)}", f"g:case={left[-1].islower()},{right[0].isupper()}", f"g:onset={VOWEL.match(right) is not None},{VOWEL.match(left[-1]) is not None}"]

    def gaps(self, word: str) -> list[int]:
        return [i for i in range(2, len(word) - 1) if self.known(word[:i]) and self.known(word[i:])]

    def _gap_examples(self, rng: random.Random) -> list:
        words, out = self.words(), []
        for w in words:  # each word, and what a break leaves of it, as if it weren't known
            out += [(self.gap_features(x, i), ["keep", "insert"], "keep") for x in (w, w, w[1:], w[2:], w[2:]) for i in range(2, len(x) - 1) if x == w or self._rank(x[:i]) < 9]
        often = [math.exp(self.log[w]) for w in words]
        for _ in range(len(words) and 2000):
            a, b = rng.choices(words, often, k=2)
            out += [(self.gap_features(a + b, i), ["keep", "insert"], "insert" if i == len(a) else "keep") for i in self.gaps(a + b) if not self.known(a + b)]
        return out

    def parted(self, token: str) -> str:
        """The token with a lost blank put back between two known words."""
        core = token.strip(EDGE)
        if len(core) < 4 or not core.isalpha() or self.known(core):
            return token
        at = next((i for i in self.gaps(core) if self.chars.best(self.gap_features(core, i), ["keep", "insert"]) == "insert"), 0)
        return token.replace(core, f"{core[:at]} {core[at:]}", 1) if at else token

    def edited(self, token: str) -> tuple[str, int]:
        """The token with its doubtful characters decided, and how many of them stood for a letter."""
        at = n = 0
        for _ in range(len(token)):
            if (m := DOUBT.search(token, at)) is None:
                break
            i = m.start()
            f, options = self.char_features(token, i)
            op = self.chars.best(f, options) if len(options) > 1 else "keep"
            upper = sum(c.isupper() for c in token) * 2 > sum(c.isalpha() for c in token)
            n += op not in ("keep", "delete")
            if op == "tone":
                letter = next(k for k, v in TONED.items() if v == token[i - 1].lower() + token[i])
                token = token[: i - 1] + (letter.upper() if token[i - 1].isupper() else letter) + token[i + 1 :]
            elif op == "delete":
                token = token[:i] + token[i + 1 :]
            elif op != "keep":
                token = token[:i] + (op[4:].upper() if upper else op[4:]) + token[i + 1 :]
                at = i + 1
            else:
                at = i + 1
        return token, n

    def edit_token(self, token: str) -> str:
        """The token with misread characters replaced, stray marks deleted and a lost blank inserted."""
        if (known := self.fixed.get(token)) is None:
            if len(self.fixed) > 300_000:
                self.fixed.clear()
            known = self.fixed[token] = self.parted(self.edited(token)[0] if DOUBT.search(token) else token)
        return known

    def misread(self, text: str) -> int:
        """Words in which a digit or mark stands where a letter belongs."""
        n, seen = 0, self.seen
        if len(seen) > 300_000:
            seen.clear()
        for tok in text.split():
            if (v := seen.get(tok)) is None:
                v = seen[tok] = int(not tok.isalpha() and DOUBT.search(tok) is not None and self.edited(tok)[1] > 0)
            n += v
        return n

    # breaks and line ends ------------------------------------------------------------------------------------------------

    def break_features(self, m: re.Match, text: str, hidden: bool = False, counted: bool = False) -> list[str]:
        """Features of a break mark at a line's end. hidden: the whole word counts as unknown; counted: its halves as known, as
        what stands broken in the tables is among the words counted."""
        left, space, mark, right = m.groups()
        start = text.rfind(" ", 0, m.start()) + 1
        head = text[start : m.start()].rsplit("\n", 1)[-1] + left
        code = sum(c.isdigit() for c in head) > 1 or "/" in head or "-" in head
        letters = any(c.isalpha() for c in left + right)
        plain = left.isalpha() and right.isalpha()
        a, b, whole = self._rank(left), self._rank(right), not hidden and self.known(left + right)
        if counted:
            a, b = min(a, 8), min(b, 8)
        kind = f"{'own' if mark == '-' else 'soft'},{bool(space)},{code},{letters}"
        case = "same" if left.isupper() == right.isupper() or (len(left) == 1 and left.isupper()) else "title" if left[:1].isupper() and right.islower() else "mixed"
        starts = "lower" if right[:1].islower() else "upper" if right[:1].isupper() else "sign"
        syllable = f"{VOWEL.search(left) is not None},{VOWEL.search(right) is not None}"
        return [
            f"j:kind={kind}", f"j:kind={kind},{whole}", f"j:kind={kind},{syllable}", f"j:known={a < 9},{b < 9},{whole},{plain}", f"j:own={mark == '-'},{a < 9},{b < 9},{whole},{plain}", f"j:both={a < 9 and b < 9},{whole},{syllable}",
            f"j:rare={max(a, b)},{whole},{syllable}", f"j:left={a},{whole}", f"j:right={b},{whole}", f"j:case={case},{whole}", f"j:starts={starts},{left.isupper()},{left[:1].isupper()}", f"j:code={code}", f"j:space={bool(space)}", f"j:onset={VOWEL.match(right) is not None},{VOWEL.match(left[-1]) is not None},{whole}",
        ]

    def _break_examples(self, texts: list[str], rng: random.Random) -> list:
        out, words = [], self.words()

        def add(text: str, op: str, hidden: bool = False, counted: bool = False) -> None:
            if (m := next((m for m in AT_END.finditer(text)), None)) is not None:
                out.append((self.break_features(m, text, hidden, counted), ["keep", "join"], op))

        for w in words:  # words broken by the noise model
            for mark in "--" + BREAKS:
                x = self.shown(w, rng)
                if rng.random() < 0.15 and any(c in CONFUSIONS or c in TONED for c in w):
                    x = damaged(x, rng)[0]
                i = rng.randint(1, len(x) - 1)
                add(f"{rng.choice(words)} {x[:i]}{mark}\n{' ' * (rng.random() < 0.2)}{x[i:]}", "join", rng.random() < 0.3, rng.random() < 0.3)
        for _ in range(len(words) and 1500):  # hyphens and dashes that belong there
            a, b = (self.shown(rng.choice(words), rng) for _ in range(2))
            if not self.known(a + b):
                add(f"x {a}-\n{b}", "keep")
            add(f"x {a} {rng.choice('--‐')}\n{b[: rng.randint(1, len(b))]}", "keep")
            code = "".join(rng.choice(string.ascii_uppercase) for _ in range(4))
            add(f"x {rng.randint(1, 9999)}/{rng.randint(1990, 2030)}/{code[:2]}{rng.choice(BREAKS)}\n{code[2:]} {b}", "keep")
            add(f"\n- {rng.randint(1, 40)} -\n{b.capitalize()}", "keep")
            add(f"x {rng.randint(1, 99)}-\n{rng.choice((b, str(rng.randint(1, 99))))}", "keep")
        for t in texts:  # codes broken at their own hyphens, and dashes of the sample
            for m in list(CASE.finditer(t))[:4]:
                for h in [h.start() for h in re.finditer("-", m[0])]:
                    for mark in BREAKS:
                        add(f"x {m[0][:h]}{mark}\n{m[0][h + 1 :]}", "keep")
            for m in AT_END.finditer(t):
                if m[2]:
                    add(m[0], "keep")
        return out

    def joins(self, m: re.Match, text: str) -> bool:
        """Whether a break mark at a line's end broke a word (join), or belongs there (keep)."""
        return self.chars.best(self.break_features(m, text), ["keep", "join"]) == "join"

    @staticmethod
    def end_features(line: str, after: str, width: int) -> list[str]:
        """Features of the end of a line (both stripped, neither blank) in a text whose longest line is so wide."""
        last = "dash" if BROKEN.search(line + "\n") else "end" if line.endswith(SENTENCE_END) else "," if line.endswith(",") else "word"
        first = "lower" if after[0].islower() else "digit" if after[0].isdigit() else "upper" if after[0].isupper() else "sign"
        full = min(4, 5 * (len(line) + 1 + len(after.split(" ", 1)[0])) // max(1, width + 1))
        wide, capitals = width >= WIDE, line.isupper()
        return [f"e:{last},{first}", f"e:{last},{first},{wide}", f"e:{last},{wide},{full}", f"e:{last},{capitals},{after.isupper()}", f"e:{last},{first},{capitals},{wide}", f"e:{first},{full},{wide}", f"e:capitals={capitals},{wide}", f"e:full={full},{last}"]

    def _end_examples(self, texts: list[str], rng: random.Random) -> list:
        """Line ends of paragraphs, kept, and of the rows that narrow paper makes of them, joined."""
        out = []
        def flowing(t: str) -> bool:  # its lines are paragraphs: they end as sentences do
            long = [x.rstrip() for x in t.split("\n") if len(x) > 30 and not x.isupper()]
            return any(len(x) >= WIDE for x in long) and sum(x.endswith(SENTENCE_END) for x in long[1:]) >= 0.9 * len(long[1:])

        wide = [t for t in texts if flowing(t)]
        for t in (wide or texts)[:SAMPLE]:
            own = [x.strip() for x in t.split("\n")]
            for lines in (own if wide else [], None):
                if lines is None:
                    rows = [(r, k == len(rs) - 1) for w in [rng.randint(40, 95)] for x in own for rs in [narrowed(x, w)] for k, r in enumerate(rs)]
                else:
                    rows = [(x, True) for x in lines]
                width = max((len(x) for x, _ in rows), default=0)
                for x, _ in rows[:: max(1, len(rows) // 3)]:  # a line broken after a dash
                    if (at := [m.start() for m in re.finditer(" ", x)]) and (k := rng.choice(at)) and x[k + 1 :]:
                        out.append((self.end_features(x[:k] + " -", x[k + 1 :].capitalize() if rng.random() < 0.7 else x[k + 1 :], width), ["keep", "join"], "join"))
                for (x, ends), (y, _) in zip(rows, rows[1:]):
                    if x and y and not BROKEN.search(x + "\n") and (not ends or x.endswith(SENTENCE_END) or x.isupper() or rng.random() < 0.5):
                        out.append((self.end_features(x, y, width), ["keep", "join"], "keep" if ends else "join"))
        return out

    def runs_on(self, line: str, after: str, width: int) -> bool:
        """Whether a line's end stands inside a paragraph (join), or ends one (keep)."""
        return self.chars.best(self.end_features(line, after, width), ["keep", "join"]) == "join"

    # page furniture ------------------------------------------------------------------------------------------------------

    @staticmethod
    @lru_cache(100_000)
    def _shape(line: str) -> str:
        return SHAPED.sub("0", line.strip().lower())

    @classmethod
    def shape(cls, line: str) -> str:
        """Lines that may be furniture come again in other texts; paragraphs aren't kept."""
        return cls._shape(line) if len(line) <= 2 * WIDE else cls._shape.__wrapped__(line)

    @staticmethod
    @lru_cache(100_000)
    def outline(shape: str) -> str:
        return LETTERED.sub("w", shape[:400])[:24]

    def line_features(self, lines: list[str], i: int, shapes: Counter) -> list[str]:
        """lines: stripped, blank ones included."""
        s = lines[i]
        words = s.split()
        letters = len(NOT_LETTERS.sub("", s))
        digits = len(NOT_DIGITS.sub("", s))
        k = i - 1
        while k >= 0 and not lines[k]:
            k -= 1
        before = lines[k] if k >= 0 else ""
        top = 0 if k < 0 else 1 if not any(lines[:k]) else 2
        k = i + 1
        while k < len(lines) and not lines[k]:
            k += 1
        after = lines[k] if k < len(lines) else ""
        case = CASE.search(s)
        rest = self.shape(CASE.sub("N", s) if case else s)
        first, last = self.shape(words[0]), self.shape(words[-1])
        n = min(len(words), 12)
        again = shapes[rest]
        ended = s[-1:] in ".;,:"
        return [
            f"n={n}", f"first={first}", f"last={last}", f"first2={' '.join(rest.split()[:2])}", f"digits={min(digits, 6)}", f"letters={min(letters, 8)}",
            f"bare={letters == 0},{ended}", f"form={self.outline(rest[:400])}", f"ended={ended},{case is not None}", f"case={case is not None},{n}",
            f"lower={s[:1].islower()},{ended}", f"again={min(again, 3)},{ended}", f"top={min(top, 2)}", f"top={min(top, 2)},{case is not None},{':' in s}",
            f"numbered={NUMBERED.search(s) is not None},{min(again, 2)},{bool(before) and before[-1:] not in '.;:'},{after[:1].islower()}", f"long={len(s) > 90},{min(again, 2)}",
            f"broken={bool(before) and before[-1:] not in '.;:'},{ended}", f"goes={after[:1].islower()},{before[-1:] in '.;:'}", f"signs={''.join(c for c in s if c in '*–-[]:|')[:4]}", f"colon={':' in s}", f"plain={ended and s[:1].islower()}",
        ]

    @staticmethod
    def candidates(lines: list[str]) -> list[int]:
        """Lines (stripped) that could be furniture: their form is there again, they stand inside a sentence, or they are short and
        hold a number."""
        numbered = {i for i, x in enumerate(lines) if 0 < len(x) <= 90 and NUMBERED.search(x)}
        full = [i for i, x in enumerate(lines) if x]
        # a paragraph is the same form only as it is
        forms = {i: lines[i].translate(MASKED) if 90 < len(lines[i]) <= 2 * WIDE else lines[i] for i in full if i not in numbered}
        again, out = Counter(forms.values()), []
        for at, i in enumerate(full):
            x = lines[i]
            if i in numbered or again[forms[i]] > 1:
                out.append(i)
            elif 0 < at < len(full) - 1 and not x[0].islower() and lines[full[at + 1]][0].islower() and lines[full[at - 1]][-1] not in ".;:?!…" and len(x) < len(lines[full[at - 1]]):
                out.append(i)
        return out

    def furniture_lines(self, text: str) -> list[int]:
        """Numbers (from 0) of the lines that are page numbers or headers only; those of the last text are kept for its repair."""
        if self.last[0] != text:
            self.last = text, self._furniture(text)
        return self.last[1]

    def _furniture(self, text: str) -> list[int]:
        lines = [x.strip() for x in text.split("\n")]
        if len(lines) < 2:
            return []
        maybe = self.candidates(lines)
        if not maybe:
            return []
        shapes = Counter(self.shape(CASE.sub("N", lines[i])) for i in maybe)
        return [i for i in maybe if self.lines.best(self.line_features(lines, i, shapes), ["keep", "drop"]) == "drop"]

    def _line_examples(self, texts: list[str], rng: random.Random) -> list:
        out = []
        bare = re.compile(r"^\W*(?:\w{2,6}\W+)?[\dOIl|]{1,4}(?:\W{1,3}[\dOIl|]{1,4})?\W*$")
        numbers = [m[0].rstrip(".,;") for t in texts for m in CASE.finditer(t)] or ["01/2020/HS-ST"]
        names = [" ".join(w.capitalize() for w in rng.sample(sorted(self.log)[:400], 2)) for _ in range(60)] if len(self.log) >= 2 else ["A B"]
        wide = [t for t in texts if not any(bare.match(x) or (CASE.search(x) and len(x.split()) < 12 and not x.rstrip().endswith(SENTENCE_END + (",",))) for x in t.split("\n")[1:] if x.strip())]
        for t in (wide or texts)[:SAMPLE]:
            lines = [x for x in t.split("\n")]
            if rng.random() < 0.6:  # narrow lines, as scans have them
                width = rng.randint(40, 95)
                lines = [row for x in lines for row in narrowed(x, width)]
            number, court = rng.choice(numbers), f"{rng.choice(['TAND', 'Tòa án nhân dân', 'TAND'])} {rng.choice(['huyện', 'tỉnh', 'thị xã', 'quận'])} {rng.choice(names)}"
            pages = rng.randint(2, 30)
            page = rng.choice([lambda k: f"{k}", lambda k: f"- {k} -", lambda k: f"[{k}]", lambda k: f"trang {k}", lambda k: f"Trang {k}/{pages}", lambda k: f"Tờ {k} / {pages}", lambda k: f"{k}/{pages}", lambda k: f"– {k} –", lambda k: f"Page {k}"])
            head = rng.choice([f"BA {number}", f"Bản án số {number} – {court}", f"{court} * hồ sơ {number}", f"{court} – {number}", f"Hồ sơ {number}", f"Bản án {number} | {court}"])
            if rng.random() < 0.12:  # a header without a number, or a long one
                head = rng.choice([court, f"{court} – bản án", f"{court}, {rng.choice(names)}, {rng.choice(names)}, bản án của vụ án hình sự sơ thẩm xét xử công khai tại trụ sở tòa án"])
            if rng.random() < 0.15:
                head = head.upper()
            step, mixed, made = max(1, rng.choice([3, 5, 8, 15, 25])), [], set()
            kind = rng.choice(["page", "head", "both"])
            k = rng.choice([1, 1, 2, 5])
            for j, x in enumerate(lines):
                if j and j % step == 0:
                    for own in ([page(k)] if kind != "head" else []) + ([head] if kind != "page" else []):
                        if rng.random() < 0.12:
                            own = own.replace("0", "O", 1).replace("1", rng.choice("lI|"), 1)
                        if rng.random() < 0.2:
                            mixed.append("")
                        made.add(len(mixed))
                        mixed.append(own)
                        if rng.random() < 0.2:
                            mixed.append("")
                    k += 1
                mixed.append(x)
            if rng.random() < 0.15:
                mixed.insert(0, page(1))
                made = {0} | {i + 1 for i in made}
            mixed = [x.strip() for x in mixed]
            maybe = self.candidates(mixed)
            shapes = Counter(self.shape(CASE.sub("N", mixed[i])) for i in maybe)
            for i in maybe:
                if i in made or not NUMBERED.search(mixed[i]) or rng.random() < 0.5:
                    out.append((self.line_features(mixed, i, shapes), ["keep", "drop"], "drop" if i in made else "keep"))
        return out

    # both together -------------------------------------------------------------------------------------------------------

    def kinds(self, text: str) -> list[str]:
        out = []
        if self.chars is None or self.decoder.evidence(text):
            return out
        broken = BROKEN.search(text) is not None and any(self.joins(m, text) for m in AT_END.finditer(text))
        if broken:
            out.append("hyphen")
        if self.furniture_lines(text):
            out.append("running")
        if self.misread(AT_END.sub(lambda m: m[1] + m[4] if self.joins(m, text) else m[0], text) if broken else text) >= LEAST_MISREAD:
            out.append("misread")
        return out

    def repair(self, text: str) -> str:
        """Continuous paragraphs: furniture dropped, broken words and lines joined, misread letters put right."""
        gone = set(self.furniture_lines(text))
        lines = [x for i, x in enumerate(text.split("\n")) if i not in gone]
        width, last = max(map(len, lines), default=0), ""
        text = "\n".join(lines)
        text = AT_END.sub(lambda m: m[1] + m[4] if self.joins(m, text) else m[0], text)
        out: list[str] = []
        for line in text.split("\n"):
            s = line.strip()
            if s and last and self.runs_on(last, s, width):
                out[-1] += " " + s
            elif s or (out and out[-1]):
                out.append(s)
            last = s
        return "\n".join(TOKEN.sub(lambda m: self.edit_token(m[0]), x) for x in out).strip()


def trained(texts: DataFrame) -> Editor:
    decoder = fitted(texts)
    own = texts.where(F.col("t").rlike(r"\S"))
    # keys alone are sorted out; the chosen texts follow by a join with this bounded table
    ids = own.select("tbl", "k").orderBy(F.xxhash64("tbl", "k"), "k").limit(SAMPLE).distinct()
    sample = own.join(F.broadcast(ids), ["tbl", "k"], "left_semi").orderBy("k", "tbl").limit(SAMPLE).select("t").collect()
    return Editor(decoder, [r.t for r in sample])


def noisy(texts: DataFrame, repair: bool = False) -> DataFrame:
    """tbl, k, kinds of noise and the repaired text where asked for; texts without noise have no row."""
    sent = texts.sparkSession.sparkContext.broadcast(trained(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = sent.value
        for batch in batches:
            rows = [(i, kinds, editor.repair(t) if repair else None) for i, t in enumerate(batch.column(2).to_pylist()) if (kinds := editor.kinds(t))]
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.string())], ["tbl", "k", "kinds", "repaired"])

    return texts.mapInArrow(run, "tbl STRING, k BIGINT, kinds ARRAY<STRING>, repaired STRING")


def p5_found(spark, d: str) -> DataFrame:
    return noisy(fields(spark, d)).select("tbl", F.col("k").alias("row_key"), F.explode("kinds").alias("kind"))


def p5_repaired(spark, d: str) -> DataFrame:
    return noisy(fields(spark, d), repair=True).select("tbl", F.col("k").alias("row_key"), "kinds", "repaired")


QUERIES = {"p5_found": p5_found, "p5_repaired": p5_repaired}
SQL: dict[str, str] = {}
