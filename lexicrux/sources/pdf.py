"""PDF files read without a library: page tree, text layer, and the page features that checks of tampering ask for.

Read are classic and object-stream files with plain or Flate streams; text is decoded by a font's ToUnicode map, else as
UTF-16 or Latin-1. What can't be opened has an error in place of pages, never an exception."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from lexicrux.sources.files import LEAST_PDF_TEXT

_FIELDS = (("page", IntegerType()), ("text", StringType()), ("fonts", ArrayType(StringType())), ("width", DoubleType()), ("height", DoubleType()), ("rotation", IntegerType()), ("images", IntegerType()), ("annots", ArrayType(StringType())))
SCHEMA = StructType([StructField("error", StringType()), StructField("pages", ArrayType(StructType([StructField(*f) for f in _FIELDS])))])
OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
REF = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/\[\]()<>]+|\[|\]|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)", re.S)
PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class File:
    def __init__(self, data: bytes):
        self.objects = {int(n): body for n, body in OBJECT.findall(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                count, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
                inner = self.stream(body)
                head = list(map(int, inner[:first].split()))[: 2 * count]
                for n, lo, hi in zip(head[::2], head[1::2], [*head[3::2], len(inner)]):
                    self.objects.setdefault(n, inner[first + lo : first + hi])

    @staticmethod
    def stream(body: bytes) -> bytes:
        m = STREAM.search(body)
        if m is None:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]

    def value(self, body: bytes, key: bytes) -> bytes:
        """What stands behind a key: the object it refers to, or the text from there on."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", body)
        if m is None:
            return b""
        rest = body[m.end() :]
        return self.objects.get(int(r[1]), b"") if (r := REF.match(rest)) else rest

    def pages(self) -> list[tuple[bytes, bytes]]:
        """Bodies of the pages in order, each with what it inherits."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        out: list[tuple[bytes, bytes]] = []

        def walk(body: bytes, above: bytes, depth: int) -> None:
            if re.search(rb"/Type\s*/Pages", body) and depth < 64:
                kids = re.match(rb"\s*\[(.*?)\]", self.value(body, b"Kids"), re.S)
                for n in REF.findall(kids[1] if kids else b""):
                    walk(self.objects.get(int(n), b""), body + above, depth + 1)
            elif body:
                out.append((body, above))

        walk(self.value(root, b"Pages"), b"", 0)
        return out

    def fonts(self, page: bytes) -> dict[bytes, tuple[str, dict[bytes, str]]]:
        """Name in the page's content -> (base font, map of codes)."""
        res = self.value(page, b"Resources")
        table = self.value(res, b"Font")
        out = {}
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", table.split(b">>")[0]):
            font = self.objects.get(int(n), b"")
            base = re.search(rb"/BaseFont\s*/([^\s/<>\[\]()]+)", font)
            out[name] = (base[1].decode("latin-1") if base else "", self.codes(self.stream(self.value(font, b"ToUnicode"))))
        return out

    @staticmethod
    @lru_cache(256)
    def codes(cmap: bytes) -> dict[bytes, str]:
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        out = {}
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            out |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                lo, hi, to = int(a, 16), int(b, 16), int(c, 16)
                out |= {(lo + i).to_bytes(len(a) // 2, "big"): chr(to + i) for i in range(min(hi - lo, 0xFFFF) + 1)}
        return out

    def text(self, page: bytes) -> str:
        fonts, at = self.fonts(page), re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        content = b"\n".join(self.stream(self.objects.get(int(n), b"")) for n in REF.findall(at[1] if at else b""))
        out: list[str] = []
        codes: dict[bytes, str] = {}
        stack: list[bytes] = []

        def show(parts: list[bytes]) -> None:
            for s in parts:
                raw = bytes.fromhex(re.sub(rb"\s", b"", s[1:-1]).decode()) if s[:1] == b"<" else ESCAPE.sub(lambda m: PLAIN.get(m[1], bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else m[1]), s[1:-1])
                if codes:
                    n = len(next(iter(codes)))
                    out.append("".join(codes.get(raw[i : i + n], "�") for i in range(0, len(raw), n)))
                else:
                    out.append(raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1"))

        for t in TOKEN.findall(content):
            if t == b"Tf" and len(stack) > 1:
                codes = fonts.get(stack[-2][1:], ("", {}))[1]
            elif t in (b"Tj", b"TJ", b"'", b'"'):
                if t in (b"'", b'"') and out:
                    out.append("\n")
                show([s for s in stack if s[:1] in (b"(", b"<")])
            elif t in (b"Td", b"TD", b"T*", b"Tm", b"ET") and out and out[-1] != "\n":
                if not (t == b"Td" and len(stack) > 1 and float(stack[-1]) == 0):
                    out.append("\n")
            else:
                stack.append(t)
                continue
            stack = []
        return "".join(out)

    def features(self, page: bytes, above: bytes) -> dict:
        every = page + above
        box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", every)
        turn = re.search(rb"/Rotate\s+(-?\d+)", every)
        marks = re.match(rb"\s*\[(.*?)\]", self.value(page, b"Annots"), re.S)
        kinds = [m[1].decode("latin-1") for n in REF.findall(marks[1] if marks else b"") if (m := re.search(rb"/Subtype\s*/(\w+)", self.objects.get(int(n), b"")))]
        pictures = self.value(self.value(every, b"Resources"), b"XObject").split(b">>")[0]
        n = sum(b"/Image" in self.objects.get(int(x), b"") for x in REF.findall(pictures))
        size = [float(x) for x in box.groups()] if box else None
        return {"fonts": sorted({f for f, _ in self.fonts(every).values()}), "width": size and size[2] - size[0], "height": size and size[3] - size[1], "rotation": int(turn[1]) % 360 if turn else 0, "images": n, "annots": kinds}


def read(data: bytes | None) -> dict:
    if not data or b"%PDF" not in data[:1024]:
        return {"error": "not_pdf", "pages": []}
    try:
        f = File(data)
        rows = [{"page": i, "text": f.text(p + a), **f.features(p, a)} for i, (p, a) in enumerate(f.pages())]
    except (ValueError, TypeError, zlib.error, RecursionError) as x:
        return {"error": f"unreadable: {type(x).__name__}", "pages": []}
    return {"error": None if rows else "no_pages", "pages": rows}


@F.pandas_udf(SCHEMA)
def pages_of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """error (not_pdf, no_pages, unreadable) and pages of files' contents."""
    for s in parts:
        rows = [read(x) for x in s]
        yield pd.DataFrame({"error": [r["error"] for r in rows], "pages": [r["pages"] for r in rows]})


def layer(pages: Column, least: int = LEAST_PDF_TEXT) -> Column:
    """Text of a file's pages, whether it is a scan (too little text), and the text layer: null for a scan."""
    text = F.array_join(F.transform(pages, lambda p: p["text"]), "\n")
    scan = F.length(F.regexp_replace(text, r"\s+", "")) < least
    return F.struct(text.alias("text"), scan.alias("is_scanned"), F.when(~scan, text).alias("layer"))


def extracted(pages: Column, recognised: Column) -> Column:
    """The text layer, or what a recogniser made of a scan, and which; without either an error instead of a text."""
    x = layer(pages)
    own = F.coalesce(x["layer"], F.nullif(F.trim(recognised), F.lit("")))
    return F.struct(own.alias("text"), F.when(x["layer"].isNotNull(), "text_layer").when(own.isNotNull(), "recognised").alias("source"), F.when(own.isNull(), "scan_without_text").alias("error"))
