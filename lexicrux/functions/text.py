"""Text scalars as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: the vowels of Vietnamese with their tones, and đ
VOWELS = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
# fixed values: a letter of legacy fonts and what it stands for
LEGACY_FROM, LEGACY_TO = "ƣƢ", "ưƯ"
WORD = r"[\p{L}\p{N}_]+"
SPACES = "[ \t ]+"


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))


FOLD_FROM = VOWELS + VOWELS.upper()
FOLD_TO = "".join(_bare(c) for c in FOLD_FROM)


@F.pandas_udf(StringType())
def _composed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Unicode composition; only texts with combining marks are sent to Python, of the others a null."""
    return F.coalesce(_composed(F.when(c.rlike(r"\p{M}"), c)), c)


def legacy_fixed(c: Column) -> Column:
    return F.when(c.rlike(f"[{LEGACY_FROM}]"), F.translate(c, LEGACY_FROM, LEGACY_TO)).otherwise(c)


MARKS = "[\u0323\u0300\u0301\u0303\u0309]"


def marks_attached(c: Column) -> Column:
    """Tone marks that stand behind blanks go back to their letter. Blanks are matched, not letters, so that a text without
    such marks is passed over quickly; a mark that gets its letter is no letter itself, so one pass is enough."""
    return F.when(c.rlike(MARKS), F.regexp_replace(c, rf"(?<=[\p{{L}}\p{{N}}_])[ \u00a0]+(?={MARKS})", "")).otherwise(c)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normal(c: Column) -> Column:
    """Legacy letters, detached marks, composition, blanks per line."""
    lines = F.split(F.regexp_replace(nfc(marks_attached(legacy_fixed(c))), SPACES, " "), "\n")
    joined = F.array_join(F.transform(lines, _strip), "\n")
    return _strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def flat(c: Column) -> Column:
    """One stream: blank and number-only lines dropped, lines joined by a blank."""
    lines = F.filter(F.split(c, "\n"), lambda x: (_strip(x) != "") & ~_strip(x).rlike(r"^\p{Nd}+$"))
    return _strip(F.regexp_replace(F.array_join(lines, " "), SPACES, " "))


def folded(c: Column, keep_d: bool = False) -> Column:
    """Without accents; đ becomes d unless kept."""
    out = F.translate(c, FOLD_FROM, FOLD_TO)
    return out if keep_d else F.translate(out, "đĐ", "dD")


def case_key(c: Column) -> Column:
    """Letters and digits of a judgment's number, folded, upper case; '' for null."""
    return F.coalesce(F.regexp_replace(F.upper(folded(c)), "[^A-Z0-9]", ""), F.lit(""))


def core_number(key: Column) -> Column:
    lead = F.regexp_extract(key, r"^(\d+)", 1)
    return F.when(lead == "", key).otherwise(lead)


def court_key(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(F.upper(folded(c)), "[^A-Z0-9]", " "), " +", " ")), F.lit(""))


def iso_date(c: Column) -> Column:
    """yyyy-mm-dd of an ISO or day-first date, '' otherwise; whether the day exists is not asked."""
    t = _strip(c)
    iso, own = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$"
    part = lambda rx, i, n: F.lpad(F.regexp_extract(t, rx, i), n, "0")
    return (
        F.when(t.rlike(iso), F.concat_ws("-", part(iso, 1, 4), part(iso, 2, 2), part(iso, 3, 2)))
        .when(t.rlike(own), F.concat_ws("-", part(own, 3, 4), part(own, 2, 2), part(own, 1, 2)))
        .otherwise(F.lit(""))
    )


def written_date(c: Column) -> Column:
    """dd/mm/yyyy of the written form, else of the numeric form, else the text itself."""
    long, short = r"(?i)(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})", r"(\d{1,2})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{4})"
    out = lambda rx: F.concat_ws("/", *(F.lpad(F.regexp_extract(c, rx, i), n, "0") for i, n in ((1, 2), (2, 2), (3, 4))))
    return F.when(c.rlike(long), out(long)).when(c.rlike(short), out(short)).otherwise(c)


def pdf_timestamp(c: Column) -> Column:
    """D:YYYYMMDDHHmmSS, later parts optional; the zone is ignored, dates that don't exist are null."""
    rx = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?"
    p = [F.regexp_extract(c, rx, i) for i in range(1, 7)]
    num = lambda i, d: F.when(p[i] == "", F.lit(d)).otherwise(p[i].cast("int"))
    return F.when(c.rlike(rx), F.try_make_timestamp(p[0].cast("int"), num(1, 1), num(2, 1), num(3, 0), num(4, 0), num(5, 0).cast("decimal(8,6)")))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def article_refs(c: Column) -> Column:
    """Different `Điều N`, first seen first."""
    found = F.regexp_extract_all(c, F.lit(r"(?iu)Điều\s+(\d+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.concat(F.lit("Điều "), x)))


# fixed values: words that say nothing about a crime
CRIME_STOP = ("tội", "về", "và", "các", "quy", "định")


def crime_words(crimes: Column) -> Column:
    every = F.flatten(F.transform(F.filter(crimes, lambda x: x.isNotNull()), words))
    return F.array_except(F.array_distinct(every), F.array(*map(F.lit, CRIME_STOP)))


def law_key(c: Column) -> Column:
    """Name of a law without year and what follows, blanks collapsed, lower case."""
    s = F.regexp_replace(_strip(c), r"\s*(?:năm\s+)?(?:19|20)\d{2}.*$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), "^[ ,;.]+|[ ,;.]+$", ""))


# fixed values
LAW_STOP = ("của", "và", "về", "số", "the")


def law_in_title(law: Column, title: Column) -> Column:
    """All telling words of the law's name stand in the title, and both or neither speak of procedure."""
    norm, t = law_key(law), F.lower(F.coalesce(title, F.lit("")))
    tokens = F.filter(F.split(norm, " "), lambda w: (w != "") & ~w.isin(*LAW_STOP))
    return (F.size(tokens) > 0) & F.forall(tokens, lambda w: F.contains(t, w)) & (F.contains(t, F.lit("tố tụng")) == F.contains(norm, F.lit("tố tụng")))


# fixed values: parts of a judgment's number and the kind of case, in the order they are tried
CASE_TYPES = (("HNGĐ", "hôn nhân và gia đình"), ("HNGD", "hôn nhân và gia đình"), ("KDTM", "kinh doanh thương mại"), ("LĐ", "lao động"), ("HS", "hình sự"), ("DS", "dân sự"), ("HC", "hành chính"))


def case_suffix(number: Column) -> Column:
    parts = F.split(F.regexp_replace(number, r"\s+", ""), "/", 3)
    return F.when(F.size(parts) == 3, parts[2])


def case_type(number: Column) -> Column:
    s, out = case_suffix(number), F.lit(None).cast("string")
    for code, name in reversed(CASE_TYPES):
        out = F.when(F.contains(s, F.lit(code)), F.lit(name)).otherwise(out)
    return out


def case_stage(number: Column) -> Column:
    s = case_suffix(number)
    return F.when(F.contains(s, F.lit("PT")), F.lit("phúc thẩm")).when(F.contains(s, F.lit("ST")), F.lit("sơ thẩm"))


def matching_key(crimes: Column, articles: Column, facts: Column) -> Column:
    part = lambda a: F.coalesce(F.nullif(F.array_join(a, "; "), F.lit("")), F.lit("—"))
    return F.trim(F.concat(F.lit("Tội danh: "), part(crimes), F.lit(". Điều luật: "), part(articles), F.lit(". Tình tiết: "), F.coalesce(facts, F.lit(""))))


def between(c: Column, first: str, last: str, limit: int, skip: int, cap: int | None = None) -> Column:
    """Text between two headings; without the second the `limit` characters after the first, without both those from skip."""
    a = F.regexp_instr(c, F.lit(f"(?iu){first}"))
    head = F.length(F.regexp_extract(c, f"(?iu){first}", 0))
    after = F.substring(c, a + head, F.length(c))
    b = F.regexp_instr(c, F.lit(f"(?iu){last}"))
    seg = F.when((a > 0) & (b >= a + head + 1), F.substring(c, a + head, b - a - head)).when(a > 0, F.substring(after, F.lit(1), F.lit(limit))).otherwise(F.substring(c, skip + 1, limit))
    out = F.trim(F.regexp_replace(seg, r"\s+", " "))
    return F.substring(out, 1, cap or limit)


def number_of(token: Column, money: Column) -> Column:
    """A number as written in Vietnamese: dots group, a comma is decimal, but in money it groups as well."""
    t = F.regexp_replace(F.trim(token), r"\.", "")
    return F.when(money, F.regexp_replace(t, ",", "")).otherwise(F.regexp_replace(t, ",", ".")).try_cast("double")


def sentences(c: Column) -> Column:
    """Sentences of a text: line ends and blanks after . ! ? ; … part them."""
    cut = F.split(F.regexp_replace(c, r"(?<=[.!?;…])\s+|\n+", "\u0001"), "\u0001")
    return F.filter(F.transform(cut, _strip), lambda x: x != "")
