"""Labelled spans with offsets, as column expressions: pattern scans, overlap policy, gaps, sections.

Offsets count code points and are half open. Python's \\w leaves combining marks out, so word classes are written out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,label:string,text:string>"

# fixed values: alphabets, words and patterns of the span labels, in the order of the labels' ranks below ------------------
UPPER = "A-ZĐÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴ"
LOWER = "a-zđàáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
CAP = f"[{UPPER}][{LOWER}]*"
UP = rf"(?!CỘNG\b|NƯỚC\b|NHẬN\b|XÉT\b|QUYẾT\b|ĐỘC\b|THẨM\b|TM\b|HỘI\b|NHÂN\s+DANH)[{UPPER}][{UPPER}0-9.]+"
NAME = rf"[{UPPER}][{LOWER}{UPPER}]*(?:\s+[{UPPER}][{LOWER}{UPPER}]*){{0,5}}"
GLUE = r"\s*:?\s*(?:\d+\.\s*)?(?:[+\-–]\s*)?(?:(?:[Ôô]ng|[Bb]à|[Aa]nh|[Cc]hị|[Ee]m|[Cc]háu)\s+)?"
TAIL = r"(?:\s+(?:năm\s+)?\d{4})?(?:\s*,?\s*\(?\s*sửa\s+đổi,?\s+bổ\s+sung\s+năm\s+\d{4}\s*\)?)?"
DOC_NO = r"(?:số\s*:?\s*)?\d+/\d{4}/[A-ZĐ0-9.-]+(?:\s+ngày\s+(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}))?"
NUM = r"\d{1,3}\s*(?:\([^)]{1,60}\))?"
STOP_VERB = r"(?:Căn\s+cứ|Áp\s+dụng|Xét|QUYẾT|[Xx]ử\s+phạt|[Pp]hạt\s+bổ\s+sung|[Tt]uyên\s+(?:bố|xử|án)|[Bb]uộc)"
CRIME_HEAD = (
    r"(?:vận\s+chuyển|tàng\s+trữ|mua\s+bán|sản\s+xuất|trộm\s+cắp|cướp(?:\s+giật)?|cưỡng\s+đoạt|lừa\s+đảo|lạm\s+dụng\s+tín\s+nhiệm"
    r"|giết\s+người|cố\s+ý\s+gây\s+thương\s+tích|đánh\s+bạc|tổ\s+chức\s+đánh\s+bạc|hiếp\s+dâm|giao\s+cấu|dâm\s+ô"
    r"|chống\s+người\s+thi\s+hành\s+công\s+vụ|vi\s+phạm\s+quy\s+định|gây\s+rối\s+trật\s+tự|chứa\s+chấp|tiêu\s+thụ|làm\s+giả|tham\s+ô"
    r"|nhận\s+hối\s+lộ|đưa\s+hối\s+lộ|bắt\s+cóc|hủy\s+hoại\s+tài\s+sản)"
)
#: label, pattern, group; a pattern's group 1 ends where the match ends, or one character before (quoted crimes).
PATTERNS = (
    ("LEGAL_BASIS", r"(?:Căn\s+cứ(?:\s+vào)?|Áp\s+dụng)(?!\s+biện\s+pháp)\s+[^.;]{0,80}?(?:[Đđ]iều\s+\d|Bộ\s+[Ll]uật|Luật\s|Nghị\s+quyết|Nghị\s+định|Pháp\s+lệnh)[^.]{0,400}?(?=\.(?=\s|$)|[;,]\s*" + STOP_VERB + r"|$)", 0),
    ("CASE_NUMBER", r"\b\d{1,4}\s*/\s*\d{4}/[A-ZĐ][A-ZĐ0-9]*(?:\s*-\s*[A-ZĐ][A-ZĐ0-9]*)*", 0),
    ("COURT", rf"T[OÒ][AÀ]\s+ÁN\s+(?:NHÂN\s+DÂN|QUÂN\s+SỰ)(?:(?:,\s*|\s+){UP})*", 0),
    ("COURT", rf"[Tt][oò][aà]\s+án\s+(?:nhân\s+dân|quân\s+sự)(?:\s+(?:tối\s+cao|cấp\s+cao\s+tại|thành\s+phố|tỉnh|huyện|quận|thị\s+xã|khu\s+vực))?(?:\s+{CAP})*(?:\s*,\s*(?:tỉnh|thành\s+phố|TP\.?)(?:\s+{CAP})+)?", 0),
    ("CASE_TYPE", r"(?i:vụ\s+án\s+(hình\s+sự|dân\s+sự|hành\s+chính|hôn\s+nhân(?:\s+(?:và\s+)?gia\s+đình)?|kinh\s+doanh,?\s+thương\s+mại|lao\s+động))", 1),
    ("DEFENDANT", rf"(?:[Cc]ác\s+)?[Bb]ị\s+cáo(?:\s+có\s+kháng\s+cáo)?{GLUE}({NAME})", 1),
    ("PLAINTIFF", rf"[Nn]guyên\s+đơn{GLUE}({NAME})", 1),
    ("VICTIM", rf"(?:[Nn]gười\s+)?[Bb]ị\s+hại{GLUE}({NAME})", 1),
    ("RELATED_PARTY", rf"[Nn]gười\s+có\s+(?:quyền\s+lợi,?\s+(?:và\s+)?nghĩa\s+vụ\s+liên\s+quan|QLNVLQ){GLUE}({NAME})", 1),
    ("LAW_NAME", r"(?:Bộ\s+[Ll]uật\s+(?:[Tt]ố\s+tụng\s+)?(?:[Hh]ình\s+sự|[Dd]ân\s+sự|[Ll]ao\s+động|[Hh]àng\s+hải)|Luật\s+(?:[Tt]ố\s+tụng\s+)?(?:hôn\s+nhân\s+(?:và\s+)?gia\s+đình|đất\s+đai|nhà\s+ở|doanh\s+nghiệp|thương\s+mại|đầu\s+tư|xây\s+dựng|giao\s+thông\s+đường\s+bộ|bảo\s+hiểm\s+xã\s+hội|lao\s+động|hình\s+sự|dân\s+sự|thi\s+hành\s+án(?:\s+[a-zđ]\S*)*"
     rf"|{CAP}(?:\s+[{LOWER}]+){{0,6}})|Nghị\s+quyết\s+{DOC_NO}|Nghị\s+định\s+{DOC_NO}|Pháp\s+lệnh\s+[{LOWER}]+(?:\s+[{LOWER}]+){{0,6}})" + TAIL, 0),
    ("ARTICLE", r"[Đđ]iều\s+\d+[a-zđ]?\b", 0),
    ("CLAUSE", r"[Kk]hoản\s+\d+\b", 0),
    ("POINT", r"[Đđ]iểm\s+[a-zđ]\b(?=[^.]{0,40}?(?:[Kk]hoản|[Đđ]iều))", 0),
    ("CRIME", r"tội\s*:?\s*[“\"]([^”\"]{3,120})[”\"]", 1),
    ("CRIME", rf"(?:về|phạm)\s+(?:vào\s+)?tội\s*:?\s+((?:{CAP}|{CRIME_HEAD})[^.;,:“”\"()]{{0,90}}?)(?=\s+(?:quy\s+định|theo)\b|\s*[.;,:“”\"()])", 1),
    ("VIOLATION_ACT", r"(?:có|đã\s+(?:thực\s+hiện|có)|thực\s+hiện)\s+hành\s+vi\s+(?!phạm\s+tội\s+quả\s+tang\b)([^.;,]{10,150}?)(?=(?<!\d)[.;,](?!\d)|$)", 1),
    ("PENALTY", rf"{NUM}\s*năm(?:\s+{NUM}\s*tháng)?\s+tù(?:\s+nhưng\s+cho\s+hưởng\s+án\s+treo)?(?:\s+giam)?", 0),
    ("PENALTY", rf"{NUM}\s*tháng\s+tù(?:\s+nhưng\s+cho\s+hưởng\s+án\s+treo)?(?:\s+giam)?", 0),
    ("PENALTY", rf"{NUM}\s*(?:năm|tháng)\s+cải\s+tạo\s+không\s+giam\s+giữ", 0),
    ("PENALTY", rf"{NUM}\s*(?:năm|tháng)\s+thử\s+thách", 0),
    ("PENALTY", rf"thử\s+thách\s+(?:là\s+)?{NUM}\s*(?:năm|tháng)", 0),
    ("PENALTY", r"(?:cho\s+hưởng\s+)?án\s+treo", 0),
    ("PENALTY", r"tù\s+chung\s+thân", 0),
    ("PENALTY", r"tử\s+hình", 0),
)
DATE_NUMERIC = r"[Nn]gày\s+\d{1,2}\s*[-/.]\s*\d{1,2}\s*[-/.]\s*\d{4}"
DATE_VERBOSE = r"[Nn]gày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}"
HEADER = r"(?:Bản\s+án|Quyết\s+định)\s+(?:số|phúc\s+thẩm|sơ\s+thẩm)|Số\s*:"
MONEY = r"(?<![\d./–-])(?:\d{1,3}(?:[.,]\d{3})+|\d{4,9})(?:\s*\([^)]{1,80}\))?\s*(?:đồng|đ\b)"
DECISION = r"(?:Tuyên\s+bố|Tuyên\s+xử|Xử\s+phạt|Buộc|Áp\s+dụng\s+biện\s+pháp)\b.{5,400}?(?=[.;](?=\s|$)|$)"
RULING = r"QUYẾT\s+ĐỊNH\s*:?"
NOT_NAMES = (
    "Tại", "Theo", "Trong", "Trước", "Sau", "Khi", "Nếu", "Việc", "Về", "Và", "Các", "Những", "Không", "Có", "Đã", "Đang", "Là", "Do", "Người", "Bị",
    "Nguyên", "Hội", "Tòa", "Toà", "Viện", "Cơ", "Nhà", "Bộ", "Trại", "Ngày", "Số", "Bản", "Quyết", "Căn", "Áp", "Xét", "Tuyên", "Xử", "Buộc", "Đối",
    "Công", "Phòng", "Chi", "Sở", "Ủy", "Uỷ", "Thôn", "Ấp", "Xã", "Phường", "Khu", "Đường", "Lời", "Một", "Hai", "Ba", "Bốn", "Năm", "Sáu", "Bảy",
    "Tám", "Chín", "Mười", "Vì", "Nay", "Đến", "Từ", "Như", "Nơi", "Được",
)
RANKS = (
    "LEGAL_BASIS", "COURT_FEE", "COMPENSATION", "PENALTY", "CRIME", "LAW_NAME", "CASE_NUMBER", "COURT", "JUDGMENT_DATE", "CASE_TYPE",
    "DEFENDANT", "PLAINTIFF", "VICTIM", "RELATED_PARTY", "ARTICLE", "CLAUSE", "POINT", "MONEY_AMOUNT", "VIOLATION_ACT", "DECISION",
)
SECTIONS = (("NHAN_DANH", r"NHÂN\s+DANH"), ("NOI_DUNG", r"NỘI\s+DUNG\s+VỤ\s+ÁN"), ("NHAN_DINH", r"NHẬN\s+ĐỊNH(?:\s+CỦA\s+TÒA\s+ÁN)?"))
# ---------------------------------------------------------------------------------------------------------------------------


def matches(text: Column, pattern: str, label: str | Column = "", group: int = 0) -> Column:
    """All matches of a pattern with offsets. Texts between the matches and the matches themselves add up to the text, so
    their running length gives the places; a group that ends with its match is placed from there."""
    rx = F.lit("(?Ud)" + pattern)
    found, between = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, "(?Ud)" + pattern, -1)
    inner = F.regexp_extract_all(text, rx, F.lit(group)) if group else found
    name = F.lit(label) if isinstance(label, str) else label
    # the three arrays go through the aggregate as its elements: named inside the lambda they would be computed anew each step
    rows = F.filter(F.arrays_zip(found.alias("m"), between.alias("b"), inner.alias("p")), lambda x: x["m"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["b"]) + F.length(x["m"])
        stop = end - F.when(F.endswith(x["m"], x["p"]), 0).otherwise(1)
        one = F.struct((stop - F.length(x["p"])).cast("int").alias("start"), stop.cast("int").alias("end"), name.alias("label"), x["p"].alias("text"))
        return F.struct(end.cast("int").alias("at"), F.array_append(acc["out"], one).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.coalesce(F.aggregate(rows, start, step, lambda acc: acc["out"]), F.array().cast(f"array<{SPAN}>"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def occurrence(text: Column, part: Column, nth: int = 1) -> Column:
    """Place (from 0) of the nth occurrence of a part in a text, overlapping ones counted; null where there are fewer."""
    at = F.lit(0)
    for _ in range(nth):
        at = F.nullif(F.call_function("locate", part, text, at + 1), F.lit(0))
    return at - 1


def window_before(text: Column, start: Column, n: int) -> Column:
    return F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))


def dates(text: Column) -> Column:
    """Dates of a judgment: numeric ones behind its number, written ones near a hearing or the header."""
    header = f"(?Ud){HEADER}"
    numeric = F.filter(matches(text, DATE_NUMERIC, "JUDGMENT_DATE"), lambda s: window_before(text, s["start"], 120).rlike(header))
    verbose = F.filter(
        matches(text, DATE_VERBOSE, "JUDGMENT_DATE"),
        lambda s: ~window_before(text, s["start"], 30).rlike(r"(?Ud)\d+/\d{4}/[\w-]+\s*$")
        & (F.substring(text, s["end"] + 1, F.lit(160)).rlike(r"(?Ud)xét\s+xử|tuyên\s+án") | window_before(text, s["start"], 160).rlike(header) | window_before(text, s["start"], 40).rlike(r"(?Ud)[Tt]uyên\s+án\s*:?\s*$")),
    )
    return F.concat(numeric, verbose)


def money(text: Column) -> Column:
    """Amounts, told apart by the 60 characters before and the 40 after them."""

    def kind(s: Column) -> Column:
        near = F.lower(F.concat(window_before(text, s["start"], 60), F.lit(" | "), F.substring(text, s["end"] + 1, F.lit(40))))
        label = F.when(F.contains(near, F.lit("án phí")) | F.contains(near, F.lit("lệ phí")), "COURT_FEE").when(F.contains(near, F.lit("bồi thường")), "COMPENSATION").otherwise("MONEY_AMOUNT")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), label.alias("label"), s["text"].alias("text"))

    return F.transform(matches(text, MONEY), kind)


def all_spans(text: Column) -> Column:
    """Spans of every label, overlaps and all."""
    parts = []
    for label, pattern, group in PATTERNS:
        found = matches(text, pattern, label, group)
        if label in ("DEFENDANT", "PLAINTIFF", "VICTIM", "RELATED_PARTY"):
            found = F.filter(found, lambda s: ~F.split(s["text"], r"\s+")[0].isin(*NOT_NAMES))
        parts.append(found)
    return F.concat(*parts, dates(text), money(text))


def resolved(spans: Column) -> Column:
    """Greedy choice without overlaps: higher rank, then longer, then earlier."""
    rank = F.create_map(*[F.lit(x) for i, label in enumerate(RANKS) for x in (label, i)])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(F.coalesce(rank[s["label"]], F.lit(99)).alias("rank"), (s["start"] - s["end"]).alias("size"), s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["text"].alias("text"))))
    plain = F.transform(order, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["text"].alias("text")))
    keep = lambda acc, s: F.when(F.exists(acc, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"])), acc).otherwise(F.array_append(acc, s))
    return F.array_sort(F.aggregate(plain, F.array().cast(f"array<{SPAN}>"), keep))


def last_match_end(text: Column, pattern: str) -> Column:
    return F.array_max(F.transform(matches(text, pattern), lambda s: s["end"]))


def gaps(spans: Column, start: Column, end: Column) -> Column:
    """What spans sorted by start leave uncovered of [start, end)."""
    inside = F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > start))
    pair = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        out = F.when(s["start"] > acc["at"], F.array_append(acc["out"], pair(acc["at"], s["start"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).cast("int").alias("at"), out.alias("out"))

    begun = F.struct(start.cast("int").alias("at"), none.alias("out"))
    return F.aggregate(inside, begun, step, lambda acc: F.when(acc["at"] < end, F.array_append(acc["out"], pair(acc["at"], end))).otherwise(acc["out"]))


def decisions(text: Column, kept: Column) -> Column:
    """The rest of the ruling's sentences, after the last ruling marker, that no kept span covers; cut to words."""
    word = r"[\p{L}\p{N}_]"

    def trimmed(g: Column) -> Column:
        seg = F.substring(text, g["start"] + 1, g["end"] - g["start"])
        lead = F.length(F.regexp_extract(seg, r"^([^\p{L}\p{N}_]*)", 1))
        core = F.regexp_extract(seg, rf"(?s){word}(?:.*{word})?", 0)
        a = (g["start"] + lead).cast("int")
        return F.struct(a.alias("start"), (a + F.length(core)).cast("int").alias("end"), F.lit("DECISION").alias("label"), core.alias("text"))

    def after(known: Column) -> Column:
        tail = F.substring(text, known["zone"] + 1, F.length(text))
        found = F.transform(matches(tail, DECISION, "DECISION"), lambda s: F.struct((s["start"] + known["zone"]).alias("start"), (s["end"] + known["zone"]).alias("end")))
        open_ = F.flatten(F.transform(found, lambda s: gaps(known["kept"], s["start"], s["end"])))
        return F.filter(F.transform(open_, trimmed), lambda s: F.length(s["text"]) >= 2)

    known = F.struct(last_match_end(text, RULING).alias("zone"), kept.alias("kept"))
    return F.coalesce(let(known, after), F.array().cast(f"array<{SPAN}>"))


def entities(text: Column) -> Column:
    """Non-overlapping spans of all labels, by start."""
    return let(resolved(all_spans(text)), lambda kept: F.array_sort(F.concat(kept, decisions(text, kept))))


def sections(text: Column) -> Column:
    """Parts of a judgment by their headings, each looked for after the one before; the ruling is the last of its marker."""
    n = F.length(text)
    mark = lambda name, at: F.struct(F.lit(name).alias("name"), at.cast("int").alias("start"))
    seen = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<name:string,start:int>>").alias("marks"))

    def looker(name: str, pattern: str):
        def look(acc: Column) -> Column:
            def put(at: Column) -> Column:
                start = acc["cursor"] + at - 1
                return F.struct(F.when(at > 0, start).otherwise(acc["cursor"]).cast("int").alias("cursor"), F.when(at > 0, F.array_append(acc["marks"], mark(name, start))).otherwise(acc["marks"]).alias("marks"))

            return let(F.regexp_instr(F.substring(text, acc["cursor"] + 1, n), F.lit("(?Ud)" + pattern)), put)

        return look

    for name, pattern in SECTIONS:
        seen = let(seen, looker(name, pattern))

    def ruled(acc: Column) -> Column:
        def put(at: Column) -> Column:
            last = F.coalesce(F.array_max(F.filter(at, lambda x: x >= acc["cursor"])), F.array_max(at))
            return F.when(F.size(at) > 0, F.array_append(acc["marks"], mark("QUYET_DINH", last))).otherwise(acc["marks"])

        return let(F.transform(matches(text, RULING), lambda s: s["start"]), put)

    def led(marks: Column) -> Column:
        lead = F.array(mark("PREAMBLE", F.lit(0)))
        return F.when(F.coalesce(F.get(marks, F.lit(0))["start"], F.lit(1)) > 0, F.concat(lead, marks)).otherwise(marks)

    def closed(marks: Column) -> Column:
        end = lambda i: F.coalesce(F.get(marks, i + 1)["start"], n).cast("int")
        return F.transform(marks, lambda s, i: F.struct(s["name"].alias("name"), s["start"].alias("start"), end(i).alias("end"), (end(i) >= s["start"]).alias("is_wellformed")))

    return let(let(let(seen, ruled), led), closed)


# fixed values: phrases of mitigating and aggravating circumstances
MITIGATING = (
    "tự nguyện bồi thường", "tự nguyện sửa chữa", "bồi thường thiệt hại", "khắc phục hậu quả", "ngăn chặn hoặc làm giảm bớt tác hại", "làm giảm bớt tác hại",
    "vượt quá giới hạn phòng vệ chính đáng", "vượt quá yêu cầu của tình thế cấp thiết", "bị kích động về tinh thần", "hoàn cảnh đặc biệt khó khăn",
    "chưa gây thiệt hại", "gây thiệt hại không lớn", "phạm tội lần đầu", "bị đe dọa hoặc cưỡng bức", "phạm tội do lạc hậu", "thành khẩn khai báo",
    "ăn năn hối cải", "tích cực hợp tác", "lập công chuộc tội", "thành tích xuất sắc", "người có công với cách mạng",
)
AGGRAVATING = (
    "phạm tội có tổ chức", "có tính chất chuyên nghiệp", "lợi dụng chức vụ, quyền hạn", "có tính chất côn đồ", "động cơ đê hèn", "cố tình thực hiện tội phạm đến cùng",
    "phạm tội 02 lần trở lên", "phạm tội 2 lần trở lên", "phạm tội nhiều lần", "tái phạm nguy hiểm", "tái phạm", "lợi dụng hoàn cảnh chiến tranh",
    "lợi dụng tình trạng khẩn cấp", "lợi dụng thiên tai, dịch bệnh", "thủ đoạn tinh vi", "thủ đoạn xảo quyệt", "thủ đoạn tàn ác", "gây nguy hại cho nhiều người",
    "xúi giục người dưới 18 tuổi", "che giấu tội phạm",
)


def factors(text: Column) -> Column:
    """Spans of mitigating and aggravating phrases, whatever their case, accents, blanks and punctuation."""
    import re
    import unicodedata

    from lexicrux.functions.text import folded

    def pattern(phrases: tuple[str, ...]) -> str:
        bare = ["".join(c for c in unicodedata.normalize("NFD", p.replace("đ", "d")) if not unicodedata.combining(c)) for p in phrases]
        return r"(?i)\b(?:" + "|".join(r"[\s,]+".join(map(re.escape, re.split(r"[\s,]+", p))) for p in sorted(bare, key=len, reverse=True)) + r")\b"

    # folding keeps every letter's place, so that offsets hold
    own = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"))
    found = lambda same: F.concat(matches(same, pattern(MITIGATING), "MITIGATING_FACTOR"), matches(same, pattern(AGGRAVATING), "AGGRAVATING_FACTOR"))
    return F.array_sort(F.transform(let(folded(text), found), own))
