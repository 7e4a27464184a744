"""The engine's own operators against plain Python and against SQL."""

import glob
import io
import os
import random
import re
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexicrux.functions import cases as C
from lexicrux.functions import spans as S
from lexicrux.functions import text as T
from lexicrux.operators import citations as CI
from lexicrux.operators import evaluate as E
from lexicrux.operators import forgery as G
from lexicrux.operators import jobs as J
from lexicrux.operators import law as L
from lexicrux.operators import retrieval as R
from lexicrux.operators import segment
from lexicrux.operators import windows as W
from lexicrux.plans import catalogue
from lexicrux.sources import files
from lexicrux.streaming import jobs as stream


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


# text ----------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("raw", "want"),
    [("đƣợc Ƣu", "được Ưu"), ("Đie ̀u", "Đièu"), ("a    b", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("  a  \n  b ", "a\nb"), ("", ""), (None, None)],
)
def test_normal(spark, raw, want):
    assert one(spark, raw, T.normal) == want


def test_flat(spark):
    assert one(spark, "Dòng một\n12\n\n  \nDòng  hai\n3a", T.flat) == "Dòng một Dòng hai 3a"


def test_keys(spark):
    assert {one(spark, x, T.case_key) for x in ("17/2018/HS-ST", "17 / 2018 / HSST", "17/2018/hs_st")} == {"172018HSST"}
    assert one(spark, "31/2019/QĐST-HNGĐ", T.case_key) == "312019QDSTHNGD" and one(spark, None, T.case_key) == ""
    assert one(spark, "172018HSST", T.core_number) == "172018" and one(spark, "HSST", T.core_number) == "HSST"
    assert one(spark, " TAND Quận 1,  TP. Hồ Chí Minh", T.court_key) == "TAND QUAN 1 TP HO CHI MINH"


def test_dates(spark):
    assert [one(spark, x, T.iso_date) for x in ("2018-1-2", "1/2/2018", " 31.02.2018 ", "1-2-18", "x")] == ["2018-01-02", "2018-02-01", "2018-02-31", "", ""]
    assert one(spark, "Ngày 26 tháng 1 năm 2018", T.written_date) == "26/01/2018" and one(spark, "hôm qua", T.written_date) == "hôm qua"
    assert str(one(spark, "D:20200102030405+07'00'", T.pdf_timestamp)) == "2020-01-02 03:04:05" and one(spark, "D:20209902", T.pdf_timestamp) is None


def test_case_meta(spark):
    for number, kind, stage in (("1/2018/HS-ST", "hình sự", "sơ thẩm"), ("111/2017/HSPT", "hình sự", "phúc thẩm"), ("5 / 2018 / QĐST-HNGĐ", "hôn nhân và gia đình", "sơ thẩm"), ("2/2018/DS-PT", "dân sự", "phúc thẩm"), ("x", None, None)):
        assert (one(spark, number, T.case_type), one(spark, number, T.case_stage)) == (kind, stage)


def test_references_and_crimes(spark):
    assert one(spark, "điều 5, Điều 12 và ĐIỀU 5", T.article_refs) == ["Điều 5", "Điều 12"]
    assert set(one(spark, ["Tội trộm cắp", None, "Cướp và giết"], T.crime_words, "array<string>")) == {"trộm", "cắp", "cướp", "giết"}
    assert one(spark, "Bộ luật Hình sự năm 2015 (sửa đổi)", T.law_key) == "bộ luật hình sự"
    title = lambda law, t: one(spark, law, lambda c: T.law_in_title(c, F.lit(t)))
    assert title("Bộ luật Hình sự", "Văn bản hợp nhất Bộ luật Hình sự") and not title("Bộ luật Hình sự", "Bộ luật Tố tụng hình sự") and not title("Bộ luật Tố tụng hình sự", "Bộ luật Hình sự")


def test_numbers(spark):
    assert one(spark, "2.000.000", lambda c: T.number_of(c, F.lit(True))) == 2e6 and one(spark, "0,5", lambda c: T.number_of(c, F.lit(False))) == 0.5


# spans ---------------------------------------------------------------------------------------------------------------------
JUDGMENT = (
    "TÒA ÁN NHÂN DÂN TỈNH A Bản án số: 17/2018/HS-ST Ngày 26-01-2018. NHÂN DANH NƯỚC. NỘI DUNG VỤ ÁN: Bị cáo: Lê Thế A, người bị hại Trần B. "
    "NHẬN ĐỊNH CỦA TÒA ÁN: về tội \"Trộm cắp tài sản\" theo điểm c khoản 1 Điều 173 Bộ luật Hình sự năm 2015. QUYẾT ĐỊNH: Tuyên bố bị cáo Lê Thế A phạm tội Trộm cắp tài sản theo luật. "
    "Xử phạt bị cáo 01 (một) năm 06 (sáu) tháng tù. Buộc bồi thường 5.000.000 đồng và 200.000đ án phí."
)


def spans_of(spark, text, f):
    return [tuple(r) for r in one(spark, text, f)]


@pytest.mark.parametrize("label", sorted({x[0] for x in S.PATTERNS}))
def test_patterns_equal_python(spark, label):
    for name, rx, group in S.PATTERNS:
        if name == label:
            want = [(m.start(group), m.end(group), label, m.group(group)) for m in re.finditer(rx, JUDGMENT) if m.group(group)]
            assert spans_of(spark, JUDGMENT, lambda c: S.matches(c, rx, label, group)) == want


def test_matches_of_nothing(spark):
    assert spans_of(spark, "", lambda c: S.matches(c, r"\d+")) == [] and spans_of(spark, None, lambda c: S.matches(c, r"\d+")) == []


def test_entities_do_not_overlap(spark):
    got = spans_of(spark, JUDGMENT, S.entities)
    assert all(JUDGMENT[a:b] == t for a, b, _, t in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    by = {label: [t for _, _, lab, t in got if lab == label] for _, _, label, _ in got}
    assert by["CASE_NUMBER"] == ["17/2018/HS-ST"] and by["DEFENDANT"][0] == "Lê Thế A" and by["CRIME"] == ["Trộm cắp tài sản"] * 2
    assert by["PENALTY"] == ["01 (một) năm 06 (sáu) tháng tù"] and by["COURT_FEE"] == ["5.000.000 đồng", "200.000đ"] and by["JUDGMENT_DATE"] == ["Ngày 26-01-2018"]
    assert by["DECISION"][0].startswith("Tuyên bố bị cáo")


def test_greedy_choice(spark):
    rng = random.Random(1)
    rows = [(rng.choice(S.RANKS[:18]), rng.randint(0, 80)) for _ in range(60)]
    spans = [(a, a + rng.randint(1, 20), label, "") for label, a in rows]
    kept = []
    for s in sorted(spans, key=lambda s: (S.RANKS.index(s[2]), s[0] - s[1], s[0])):
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    got = one(spark, spans, S.resolved, f"array<{S.SPAN}>")
    assert [tuple(r) for r in got] == sorted(kept)


def test_sections(spark):
    got = spans_of(spark, JUDGMENT, S.sections)
    assert [x[0] for x in got] == ["PREAMBLE", "NHAN_DANH", "NOI_DUNG", "NHAN_DINH", "QUYET_DINH"]
    assert got[0][1] == 0 and got[-1][2] == len(JUDGMENT) and all(x[2] == y[1] for x, y in zip(got, got[1:]))
    assert spans_of(spark, "không có gì", S.sections) == [("PREAMBLE", 0, 11, True)] and spans_of(spark, "", S.sections) == [("PREAMBLE", 0, 0, True)]
    assert [x[0] for x in spans_of(spark, "NỘI DUNG VỤ ÁN x QUYẾT ĐỊNH y", S.sections)] == ["NOI_DUNG", "QUYET_DINH"]
    assert not all(x[3] for x in spans_of(spark, "QUYẾT ĐỊNH x NỘI DUNG VỤ ÁN y", S.sections))


def test_factors(spark):
    text = "Bị cáo THÀNH KHẨN  KHAI BÁO, an nan hoi cai; nhưng tái phạm nguy hiểm, lợi dụng chức vụ quyền hạn."
    assert [(x[2], x[3]) for x in spans_of(spark, text, S.factors)] == [("MITIGATING_FACTOR", "THÀNH KHẨN  KHAI BÁO"), ("MITIGATING_FACTOR", "an nan hoi cai"), ("AGGRAVATING_FACTOR", "tái phạm nguy hiểm"), ("AGGRAVATING_FACTOR", "lợi dụng chức vụ quyền hạn")]


# windows -------------------------------------------------------------------------------------------------------------------
def test_bio_decode(spark):
    tags = ["B-A", "I-A", "O", "I-A", "I-B", "B-B", "B-B", "O"]
    df = spark.createDataFrame([("d", i, 10 * i, 10 * i + 5, t, 0.9 if i % 2 else 0.7) for i, t in enumerate(tags)], "d STRING, tok INT, start INT, end INT, tag STRING, score DOUBLE")
    got = [(r.label, r.start, r.end, r.score) for r in W.bio_decode(df, "d").orderBy("ord").collect()]
    assert got == [("A", 0, 15, 0.8), ("A", 30, 35, 0.9), ("B", 40, 45, 0.7), ("B", 50, 55, 0.9), ("B", 60, 65, 0.7)]
    assert W.bio_decode(df.drop("score"), "d").count() == 5


def test_chunks_and_windows(spark):
    tags = ["O", "O", "B-A", "I-A", "I-A", "O", "O"]
    assert [tuple(r) for r in one(spark, tags, lambda c: W.chunk_ranges(c, 3), "array<string>")] == [(0, 5), (5, 7)]
    assert one(spark, [], lambda c: W.chunk_ranges(c, 3), "array<string>") == []
    assert [one(spark, n, W.sliding, "int") for n in (0, 1, 200, 201, 350, 351)] == [[], [0], [0], [0, 150], [0, 150], [0, 150, 300]]
    rng = random.Random(3)
    for n in (0, 10, 200, 201, 999):
        toks = [rng.choice(["a", "b", "c"] * 20 + ["."]) for _ in range(n)]
        want, start = [], 0
        if 0 < n <= 200:
            want = [(0, n)]
        while n > 200 and start < n:
            end = min(start + 200, n)
            while end < min(start + 250, n) and toks[end - 1] not in W.BREAKS:
                end += 1
            want.append((start, n if end >= n else end))
            if end >= n:
                break
            start = max(start + 1, end - 50)
        assert [tuple(r) for r in one(spark, toks, W.sentence_windows, "array<string>")] == want


# retrieval -----------------------------------------------------------------------------------------------------------------
def python_passages(text, target=900, overlap=150):
    sents = [s.strip() for para in re.split(r"\n+", text) for s in re.split(r"(?<=[.!?;…])\s+", para) if s.strip()]
    out, cur = [], ""
    for s in sents:
        if len(s) > target:
            out += [cur] * bool(cur) + [s[i : i + target] for i in range(0, len(s), target - overlap)]
            cur = ""
        elif cur and len(cur) + 1 + len(s) > target:
            out.append(cur)
            tail = cur[-overlap:]
            m = re.search(r"[.!?;…]\s+", tail)
            tail = cur if len(cur) <= overlap else tail[m.end() :] if m else tail[tail.find(" ") + 1 :]
            cur = f"{tail} {s}".strip()
        else:
            cur = f"{cur} {s}".strip()
    return out + [cur] * bool(cur)


def test_passages(spark, sf):
    rows = [r.full_text for r in spark.read.parquet(f"{sf}/precedents.parquet").select("full_text").limit(40).collect() if r.full_text]
    rows += ["", "một câu.", "x" * 500, "y" * 2500 + ". Câu sau.", "a. " * 900]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i INT, t STRING").select("i", R.passages(F.col("t")).alias("p"))
    for r in df.collect():
        assert r.p == python_passages(rows[r.i]), rows[r.i][:80]


def test_adaptive_k(spark):
    assert [one(spark, n, R.adaptive_k, "int") for n in (0, 1, 6, 24, 99)] == [5, 4, 5, 8, 8]


def test_fusion_is_exact(spark):
    rng = random.Random(5)
    legs = [[(i, round(rng.random(), 2)) for i in rng.sample(range(600), 500)] for _ in range(2)]
    want = Counter()
    for leg in legs:
        for rank, (i, _) in enumerate(sorted(leg, key=lambda x: (-x[1], x[0])), 1):
            want[i] += 1 / (60 + rank)
    best = sorted(want.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
    got = R.fused([spark.createDataFrame(leg, "id BIGINT, score DOUBLE") for leg in legs], "id", 10).collect()
    assert {(r.id, round(r.rrf, 9)) for r in got} == {(i, round(s, 9)) for i, s in best}


def test_match_widens(spark):
    rows = [(1, [1.0, 0.0], ["Điều 1"], None), (2, [0.0, 1.0], None, ["Trộm cắp"]), (3, [0.9, 0.1], [], []), (4, [1.0], ["Điều 1"], [])]
    df = spark.createDataFrame(rows, "rec_no BIGINT, vector ARRAY<FLOAT>, articles ARRAY<STRING>, crimes ARRAY<STRING>")
    q = {"vector": [1.0, 0.0], "articles": ["Điều 1"], "crime_words": ["cắp"]}
    assert [r.rec_no for r in R.match(df, q, 2).collect()] == [1, 2]
    assert [r.rec_no for r in R.match(df, q, 3).collect()] == [1, 3, 2]
    assert R.match(df.limit(0), q, 3).count() == 0


# law -----------------------------------------------------------------------------------------------------------------------
def test_statute(spark):
    text = "Điều 250. Tội vận chuyển\n1. Người nào thì bị phạt tù từ 02 năm đến 07 năm:\na) Có tổ chức;\ntiếp theo\nđ) Khác.\n2. Bị phạt tù từ 06 tháng đến 3 năm.\n2. Lặp lại."
    df = spark.createDataFrame([("X", 250, text), ("X", 7, "Điều 7. Ngắn\nChỉ một đoạn\nhai dòng"), ("X", 8, "")], "law_key STRING, so_dieu INT, text STRING")
    got = {(r.so_dieu, r.so_khoan): r for r in L.clauses(df).collect()}
    assert set(got) == {(250, 1), (250, 2), (7, 1)}
    assert [tuple(p) for p in got[250, 1].points] == [("a", "Có tổ chức; tiếp theo"), ("đ", "Khác.")]
    assert got[250, 2].noi_dung == "Bị phạt tù từ 06 tháng đến 3 năm." and got[7, 1].noi_dung == "Chỉ một đoạn\nhai dòng"


def test_penalties(spark):
    frames = [(r.kind, r.min, r.max) for r in one(spark, "phạt tù từ 06 tháng đến 03 năm, phạt tù từ 5 năm đến 10 năm, tù chung thân hoặc tử hình; phạt tiền từ 5.000.000 đồng đến 50.000.000 đồng; cải tạo không giam giữ đến 02 năm; phạt cảnh cáo", L.penalty_frames)]
    assert frames == [("tu_co_thoi_han", 0.5, 3.0), ("tu_co_thoi_han", 5.0, 10.0), ("tu_chung_than", None, None), ("tu_hinh", None, None), ("phat_tien", 5e6, 5e7), ("cai_tao_khong_giam_giu", 0.0, 2.0), ("canh_cao", None, None)]
    said = lambda t: (lambda r: r and tuple(r))(one(spark, t, L.pronounced))
    assert [said(t) for t in ("08 năm 09 tháng tù", "02 (hai) năm tù", "9 tháng tù", "tù chung thân", "tử hình", "24 tháng cải tạo", "")] == [("tu_co_thoi_han", 8.75), None, ("tu_co_thoi_han", 0.75), ("tu_chung_than", None), ("tu_hinh", None), None, None]


def test_sentencing(spark):
    kind = "array<struct<kind:string,min:double,max:double,unit:string>>"
    prison, life = ("tu_co_thoi_han", 2.0, 7.0, "nam"), ("tu_chung_than", None, None, None)
    check = lambda fs, k, y: one(spark, fs, lambda c: L.sentencing(F.lit(k), F.lit(y), c), kind)
    assert [check([prison], "tu_co_thoi_han", y) for y in (1.0, 2.0, 7.0, 8.0)] == ["note", "within_frame", "within_frame", "out_of_frame"]
    assert check([prison, life], "tu_co_thoi_han", 8.0) == "within_frame" and check([life], "tu_co_thoi_han", 8.0) == "note" and check([], "tu_hinh", 1.0) == "uncertain"
    assert check([prison], "tu_hinh", 1.0) == "out_of_frame" and check([life], "tu_chung_than", 1.0) == "within_frame" and check([("phat_tien", 1.0, 2.0, "dong")], "tu_co_thoi_han", 1.0) == "uncertain"


def test_charges_and_validity(spark):
    df = spark.createDataFrame([("Trộm cắp tài sản", "Tội trộm cắp tài sản"), ("Cướp", "Tội trộm cắp"), ("", "x"), ("abc", "abc")], "c STRING, t STRING")
    assert [r.m for r in df.select(L.charge_match(F.col("c"), F.col("t")).alias("m")).collect()] == ["true", "uncertain", "uncertain", "uncertain"]
    d = lambda x: F.to_date(F.lit(x))
    got = spark.range(1).select(L.in_force(d("2018-01-01"), d("2018-01-01"), d(None)).alias("a"), L.in_force(d("2017-12-31"), d("2018-01-01"), d(None)).alias("b"), L.in_force(d(None), d("2018-01-01"), d(None)).alias("c"), L.in_force(d("2020-01-02"), d("2018-01-01"), d("2020-01-01")).alias("d")).first()
    assert tuple(got) == (True, False, None, False)


def test_citations(spark):
    text = "Căn cứ điểm c khoản 1 Điều 250; điểm s, t khoản 1 Điều 051 Bộ luật Hình sự; khoản 4 khoản 5 Điều 7 Bộ luật tố tụng hình sự; Điều 8 Bộ luật Hình sự năm 1999"
    df = spark.createDataFrame([(1, text), (2, "không"), (3, None), (4, "")], "id INT, raw STRING")
    got = [(r.so_dieu, r.so_khoan, r.diem, r.law) for r in CI.citations(df, "raw").orderBy("ord", "diem").collect()]
    assert got == [(250, 1, "c", "OTHER"), (51, 1, "s", "BLHS"), (51, 1, "t", "BLHS"), (7, 5, None, "BLTTHS"), (8, None, None, "OTHER")]


def test_citations_from_spans(spark):
    rows = [("POINT", 0, "điểm c"), ("CLAUSE", 8, "khoản 1"), ("ARTICLE", 16, "Điều 250"), ("LAW_NAME", 26, "Bộ luật Hình sự"), ("CLAUSE", 200, "khoản 9"), ("ARTICLE", 300, "Điều 7")]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc STRING, label STRING, start INT, text STRING")
    got = [(r.so_dieu, r.so_khoan, r.diem, r.law, r.chain) for r in CI.reconstructed(df, "doc").orderBy("start").collect()]
    assert got == [(250, 1, "c", "BLHS", 1), (7, None, None, "UNKNOWN", 2)]


def test_reattachment_takes_the_first_way(spark):
    kind = "doc INT, chain INT, law_key STRING, so_dieu INT, so_khoan INT, diem STRING"
    law = spark.createDataFrame([("X", 5, 1, None), ("X", 5, 2, "a"), ("X", 6, 3, "b"), ("X", 9, 1, "c")], "law_key STRING, so_dieu INT, so_khoan INT, diem STRING")
    cits = spark.createDataFrame([(1, 0, "X", 5, 9, "a"), (1, 0, "X", 5, 2, None), (1, 0, "X", 6, 3, None), (1, 1, "X", 9, 1, None)], kind)
    missing = spark.createDataFrame([(1, 0, "X", 5, 9, "a"), (1, 0, "X", 5, 1, "b"), (1, 0, "X", 5, 1, "c"), (1, 0, "X", 5, 1, "z")], kind)
    got = {(r.so_dieu, r.so_khoan, r.diem): (r.way, r.to_dieu, r.to_khoan) for r in CI.reattached(missing, cits, law, "doc").collect()}
    assert got == {(5, 9, "a"): (1, 5, 2), (5, 1, "b"): (3, 6, 3), (5, 1, "c"): (4, 9, 1)}


# tampering, evaluation, jobs -----------------------------------------------------------------------------------------------
def test_tampering(spark):
    f = spark.createDataFrame([("a", "low"), ("b", "high"), ("c", "high"), ("c", "medium"), ("d", "medium"), ("d", "medium"), *[("e", "high")] * 4], "k STRING, severity STRING")
    assert {r.k: (r.score, r.level) for r in G.risk(f, "k").collect()} == {"a": (5, "low"), "b": (40, "medium"), "c": (60, "high"), "d": (40, "medium"), "e": (100, "high")}
    m = spark.createDataFrame([(1, "Adobe Photoshop", "", "D:20200101", "D:20190101", 1, False, 0), (2, "Word", None, "D:20200101", "D:20210601", 2, True, 5000), (3, None, None, None, None, None, None, None)], "k INT, producer STRING, creator STRING, creation_date STRING, mod_date STRING, num_eof INT, has_prev BOOLEAN, trailing INT")
    assert {(r.k, r.signal, r.severity) for r in G.metadata_findings(m, "k").collect()} == {(1, "metadata.producer", "high"), (1, "metadata.dates_reversed", "medium"), (2, "metadata.late_change", "low"), (2, "incremental.updates", "medium"), (2, "incremental.trailing_bytes", "medium")}
    p = spark.createDataFrame([(1, 1, ["Stamp"]), (1, 2, ["Redact", "Link"]), (2, 1, ["Link"]), (3, 1, None)], "k INT, page INT, annots ARRAY<STRING>")
    assert [(r.k, r.severity) for r in G.annotation_findings(p, "k").collect()] == [(1, "high")]
    assert tuple(one(spark, bytearray(b"%PDF x /Prev 12 %%EOF more %%EOF" + b"z" * 9), G.byte_counts, "binary")) == (2, True, 9)


def test_scores(spark):
    g = spark.createDataFrame([("d", 0, "A", 0, 5), ("d", 1, "A", 10, 15), ("d", 2, "B", 0, 5)], "doc STRING, ord INT, label STRING, start INT, end INT")
    p = spark.createDataFrame([("d", 0, "A", 0, 5), ("d", 1, "A", 4, 12), ("d", 2, "C", 0, 5)], "doc STRING, ord INT, label STRING, start INT, end INT")
    get = lambda hits: {r.label: (r.tp, r.gold, r.pred) for r in E.prf(hits, g, p).collect()}
    assert get(E.exact_hits(g, p, "doc")) == {"A": (1, 2, 2), "B": (0, 1, 0), "C": (0, 0, 1), "micro": (1, 3, 3)}
    assert get(E.overlap_hits(g, p, "doc"))["A"] == (2, 2, 2)
    assert Counter(r.part for r in E.split(spark.range(5), "id").collect()) == {"train": 5, "dev": 5}


def test_existence_of_every_precedent(spark):
    from lexicrux.operators import existence as X
    from lexicrux.plans.legal import _numbered

    d = "/root/testdata/sf0.01"
    p = _numbered(spark, d)
    q, c = p.withColumnRenamed("rec_no", "q"), p.withColumnRenamed("rec_no", "c")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got, want = rows(entry.queries()["existence_report"](spark, d)), rows(X.reports(q, c))
    assert got == want and len(got) == p.count()
    scores = {tuple(r) for r in entry.queries()["existence_score"](spark, d).collect()}
    assert scores == {tuple(r) for r in X.scored(q, c).where("score >= 0.6").collect()}


@pytest.mark.parametrize("name", ["span_prf", "span_prf_overlap"])
def test_evaluation_covers_every_label(spark, sf, name):
    from lexicrux.plans.spans import _texts, entity_spans

    texts = {r.doc_id for r in _texts(spark, sf).collect()}
    gold = [(r.id, s) for r in spark.read.parquet(f"{sf}/gold_spans.parquet").collect() if r.id in texts for s in r.spans or []]
    ids = {r.id for r in spark.read.parquet(f"{sf}/gold_spans.parquet").select("id").collect()}
    pred = [r for r in entity_spans(spark, sf).collect() if r.doc_id in ids]
    place = lambda d, s: (d, s.label, s.start, s.end)
    want = {x: (Counter(s.label for _, s in gold)[x], Counter(r.label for r in pred)[x]) for x in {s.label for _, s in gold} | {r.label for r in pred}}
    got = {r.label: r for r in entry.queries()[name](spark, sf).collect()}
    assert len(want) > 1 and {k: (r.gold, r.pred) for k, r in got.items()} == want | {"micro": (len(gold), len(pred))}
    assert got["micro"].tp == sum(r.tp for k, r in got.items() if k != "micro")
    if name == "span_prf":
        hits = Counter(place(d, s) for d, s in gold) & Counter(place(r.doc_id, r) for r in pred)
        assert got["micro"].tp == sum(hits.values())


def test_jobs(spark):
    j = spark.createDataFrame([("a", "running"), ("b", "queued"), ("c", "done")], "id STRING, status STRING")
    assert {r.id: r.status for r in J.recovered(j).collect()} == {"a": "error", "b": "queued", "c": "done"}


def test_job_stream_and_ingest(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))
    kind = "job_id STRING, status STRING, seq BIGINT"
    rows = [("a", "queued", 1), ("a", "running", 2), ("b", "queued", 3), ("a", "done", 4), ("a", "running", 5), ("a", "done", 4)]
    for i in range(0, 6, 2):
        spark.createDataFrame(rows[i : i + 2], kind).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):  # a second run finds nothing new
        stream.ingest(spark, src, out, chk, kind)
    assert Counter(tuple(r) for r in spark.read.parquet(out).collect()) == Counter(rows)
    q = stream.job_states(spark.readStream.schema(kind).parquet(src)).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("states").collect():
        last[r.job_id] = max(last.get(r.job_id, (-1, "")), (r.seq, r.status))
    assert last == {"a": (4, "done"), "b": (3, "queued")}


# sources and cases ---------------------------------------------------------------------------------------------------------
def test_files(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Một</w:t></w:p><w:p>Hai</w:p>")
    docx = bytearray(buf.getvalue())
    assert one(spark, docx, files.docx_text, "binary") == "Một\nHai\n"
    assert one(spark, bytearray(b"PK nothing"), files.docx_text, "binary") is None
    kinds = spark.createDataFrame([(bytearray(b"%PDF-1"), "x" * 401), (bytearray(b"%PDF-1"), "x"), (docx, "Một"), (bytearray(b"PK"), None), (bytearray(b"\xd0\xcf"), None)], "c BINARY, t STRING")
    assert [r.k for r in kinds.select(files.file_kind(F.col("c"), F.col("t")).alias("k")).collect()] == ["pdf-text", "scan", "docx", "docx-fail", "unknown"]
    assert one(spark, bytearray(b"%PDF-1"), files.is_pdf, "binary") and not one(spark, bytearray(b"<html>"), files.is_pdf, "binary")
    assert one(spark, "a " * 100, files.text_or_null) is None
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    assert files.files(spark, str(tmp_path), "*.pdf").count() == 1
    files.write_jsonl(spark.createDataFrame([(1, "đ")], "a INT, b STRING"), str(tmp_path / "j"))
    assert [tuple(r) for r in files.jsonl(spark, str(tmp_path / "j"), "a INT, b STRING").collect()] == [(1, "đ")]


def test_structured_blocks(spark):
    doc = '{"kids": [{"type": "h", "page number": 1, "content": "A", "kids": [{"content": ["b", " c "]}]}, {"list items": [{"content": "d"}], "kids": [{"content": "e"}]}, 7]}'
    assert [r.text for r in one(spark, doc, files.structured_blocks)] == ["A", "b c", "d", "e"] and one(spark, "{", files.structured_blocks) == [] and one(spark, None, files.structured_blocks) == []


def test_portal_links(spark):
    df = spark.createDataFrame([("k", 0, "Quyết định 1", None), ("k", 1, "Án lệ số 02/2016/AL về đất", "/a"), ("m", 0, "x", None)], "k STRING, pos INT, title STRING, href STRING")
    assert {tuple(r) for r in files.portal_links(df, "k", "title", "href").collect()} == {("k", "về đất", "/a"), ("m", "x", None)}


def test_cases(spark):
    assert one(spark, ["03 năm tù (đề nghị)", "02 (hai) năm tù"], C.pronounced_penalty, "array<string>") == "02 (hai) năm tù"
    assert one(spark, [], C.pronounced_penalty, "array<string>") == "(không rõ mức hình phạt)"
    assert one(spark, ["Bộ luật tố tụng hình sự", "Bộ luật hình sự"], C.offence_basis, "array<string>") == "Bộ luật hình sự"
    assert one(spark, "điểm c khoản 1  Điều 250; Điều 51, điều 51", C.applied_citations).startswith("điểm c khoản 1 Điều 250; Điều 51")
    assert one(spark, "Xin chào! Tôi là máy", C.useless) and not one(spark, "Phân tích", C.useless)
    assert one(spark, "Dưới đây là tóm tắt: Bị cáo trộm xe. Bị cáo bỏ trốn.", C.without_preamble) == "Bị cáo trộm xe. Bị cáo bỏ trốn."
    assert one(spark, "Nội dung như sau: " + "a" * 150 + ". " + "b" * 300, C.opening) == "a" * 150 + "."
    turns = spark.createDataFrame([(1, 0, "user", "mức án?"), (1, 1, "assistant", "2 năm"), (1, 2, "user", " "), (1, 3, "user", "hợp lý không?"), (2, 0, "user", "một")], "id INT, turn INT, role STRING, text STRING")
    assert {r.id: r.query for r in C.retrieval_query(turns, "id").collect()} == {1: "mức án? hợp lý không?", 2: "một"}


def test_pairs_and_corpus(spark):
    rows = [(1, "LEGAL_BASIS", 0, "Điều 250 Bộ luật Hình sự; Điều 51 của Bộ luật Hình sự năm 2015"), (1, "ARTICLE", 90, "Điều 7"), (1, "ARTICLE", 95, "Điều 250"), (1, "LAW_NAME", 80, "Bộ luật Dân sự"), (2, "ARTICLE", 0, "Điều 1")]
    p = C.pairs(spark.createDataFrame(rows, "id INT, label STRING, start INT, text STRING"), "id")
    assert [(r.article, r.law) for r in p.orderBy("ord").collect()] == [(250, "Bộ luật Hình sự"), (51, "Bộ luật Hình sự năm 2015"), (7, "Bộ luật Dân sự")]
    hits = spark.createDataFrame([("Điều 250", "Văn bản hợp nhất Bộ luật Hình sự"), ("Điều 51", "Bộ luật Tố tụng hình sự"), (None, "x")], "article STRING, title STRING")
    assert {r.article: r.status for r in C.checked_pairs(p, hits, "id").collect()} == {250: "found", 51: "not_found", 7: "not_found"}


# packed fields (problem 2) -------------------------------------------------------------------------------------------------
def packed(spark, rows):
    df = spark.createDataFrame([(i, g, t, "x") for i, (g, t) in enumerate(rows)], "id INT, grp STRING, t STRING, pos_ STRING")
    out = {}
    for r in segment.split_values(df).orderBy("id", "pos").collect():
        out.setdefault(r.id, []).append(r.value)
    return [out.get(i, []) for i in range(len(rows))]


def test_packed_fields(spark):
    rng = random.Random(7)
    cites = [f"khoản {rng.randint(1, 9)} Điều {rng.randint(1, 500)}{law}" for _ in range(300) for law in ("", " Bộ luật Hình sự", " Quy chế đo đạc, lưu trữ và khai thác")]
    fields, want = [], []
    for c in cites[:600]:
        fields.append(("raw", f'"{c}"' if "," in c else c))
        want.append([c])
    for _ in range(200):
        vs = rng.sample(cites, rng.randint(2, 6))
        sep = rng.choice(["; ", ", ", " / ", " và ", "; và ", "\n", " | ", "\t", " • ", "、"])
        fields.append(("raw", sep.join(vs)))
        want.append(vs)
    special = [
        ('"a ""b"", c"; "d"', ['a "b", c', "d"]), ("['khoản 1 Điều 2', 'khoản 1 Điều 3']", ["khoản 1 Điều 2", "khoản 1 Điều 3"]), ("khoản 1 Điều 2;  ; và khoản 3 Điều 4;", ["khoản 1 Điều 2", "khoản 3 Điều 4"]),
        ("điểm a, b và đ khoản 1 Điều 2", ["điểm a, b và đ khoản 1 Điều 2"]), (None, []), ("", []), (" ; ", []), ("x" * 50_000, ["x" * 50_000]),
    ]
    got = packed(spark, fields + [("raw", t) for t, _ in special])
    right = sum(g == w for g, w in zip(got, want))
    assert right >= 0.98 * len(want)
    assert got[len(fields) :] == [w for _, w in special]


def test_packed_fields_of_an_empty_table(spark):
    assert packed(spark, []) == []


# the catalogue -------------------------------------------------------------------------------------------------------------
def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_and_its_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    if name not in catalogue.SQL:
        assert df.count() >= 0
        return
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(catalogue.SQL[name])
    at = [want.columns.index(c) for c in cols]
    assert Counter(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == Counter(repr(tuple(r[i] for i in at)) for r in want.fetchall())
