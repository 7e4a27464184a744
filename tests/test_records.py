"""Operators of records, statutes, windows, fusion and verdicts on small built cases."""

import random

from pyspark.sql import functions as F

from lexicrux.functions import cases as C
from lexicrux.functions import spans as S
from lexicrux.operators import citations as K
from lexicrux.operators import evaluate as E
from lexicrux.operators import forgery as G
from lexicrux.operators import jobs as J
from lexicrux.operators import law as L
from lexicrux.operators import retrieval as R
from lexicrux.operators import verdict as V
from lexicrux.operators import windows as W
from lexicrux.plans import catalogue
from lexicrux.sources import files as Files
from lexicrux.streaming import jobs as stream


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


def test_lines_keep_their_digits(spark):
    """A builtin of two parameters passed to transform would take the place for its second."""
    text = "Điều 1. Một\n6\nThân 2\n1 2 3"
    got = Files.statute_articles(spark.createDataFrame([(1, text)], "k INT, text STRING"), "k", "text").first()
    assert got.text == text
    assert one(spark, "Từ khóa của án lệ: “0 đồng 0”; “1 ngày 1”", C.keywords) == ["0 đồng 0", "1 ngày 1"]


def test_fusion_of_three_lists(spark):
    """A row at place 63 of all three lists beats the first of one list alone."""
    rows = [(i, float(1000 - i)) for i in range(1, 63)]
    legs = [spark.createDataFrame([(i + 1000 * n, s) for i, s in rows] + [(7, 937.0)], "k INT, score DOUBLE") for n in (1, 2, 3)]
    got = [(r.k, round(r.rrf, 9)) for r in R.fused(legs, "k", 2).collect()]
    want = {}
    for leg in legs:
        for rank, r in enumerate(sorted(leg.collect(), key=lambda r: (-r.score, r.k)), 1):
            want[r.k] = want.get(r.k, 0) + 1 / (60 + rank)
    assert got == [(k, round(v, 9)) for k, v in sorted(want.items(), key=lambda x: (-round(x[1], 9), x[0]))[:2]] and got[0][0] == 7
    assert R.fused([legs[0].limit(0), legs[1].limit(0)], "k", 2).count() == 0


def test_cosine_of_many_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 5)
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)] + [(90, None), (91, [1.0])]
    df = spark.createDataFrame(rows, "id BIGINT, v ARRAY<DOUBLE>")
    got = R.cosine_topk(df, df.where("id < 30"), "id", "v", 3).collect()
    assert len(got) == 90 and all(r.q != r.id for r in got)
    assert R.cosine_topk(df, df.limit(0), "id", "v", 3).count() == 0


def test_laws(spark):
    assert [one(spark, x, L.canonical_law) for x in ("blhs", " BLTTHS ", "NQ326-2016", "BLDS 2015", None, "", "?")] == ["BLHS2015", "BLTTHS2015", "NQ326_2016", "BLDS2015", "BLHS2015", "BLHS2015", "BLHS2015"]
    assert one(spark, "BLDS2015", L.law_label) == "Bộ luật Dân sự 2015 (91/2015/QH13)" and one(spark, "X", L.law_label) == "X"
    offence = lambda law, n, part: one(spark, n, lambda c: L.is_offence(F.lit(law), c, F.lit(part)), "int")
    assert offence("BLHS2015", 173, None) and offence("BLHS2015", 5, "Phần thứ hai: các tội phạm") and not offence("BLHS2015", 5, None) and not offence("BLDS2015", 173, None) and not offence("BLHS2015", None, None)
    assert one(spark, ["02 năm tù", None, "tù chung thân", "03 năm tù"], L.severest, "array<string>").kind == "tu_chung_than"
    assert one(spark, ["02 năm tù", "03 năm tù", "3 năm tù giam"], L.severest, "array<string>").years == 3.0
    assert one(spark, [], L.severest, "array<string>") is None and one(spark, None, L.severest, "array<string>") is None


def test_statute_store_round_trip(spark, tmp_path):
    text = "Điều 173. Tội trộm cắp\n1. Bị phạt tù từ 06 tháng đến 03 năm:\na) Một;\nb) Hai.\n2. Bị phạt tù 20 năm hoặc tử hình."
    df = spark.createDataFrame([("BLHS2015", 173, text), ("BLDS2015", 1, "Điều 1. Phạm vi\nThân"), ("BLDS2015", 2, None)], "law_key STRING, so_dieu INT, text STRING")
    L.write_store(L.statute_store(df), str(tmp_path))
    s = L.read_store(spark, str(tmp_path))
    assert {(r.law_key, r.so_dieu): (r.tieu_de, r.is_offense) for r in s["articles"].collect()} == {("BLHS2015", 173): ("Tội trộm cắp", True), ("BLDS2015", 1): ("Phạm vi", False), ("BLDS2015", 2): (None, False)}
    assert sorted((r.so_khoan, r.ky_hieu) for r in s["points"].collect()) == [(1, "a"), (1, "b")]
    assert sorted((r.so_khoan, r.kind) for r in s["penalty_frames"].collect()) == [(1, "tu_co_thoi_han"), (2, "tu_co_thoi_han"), (2, "tu_hinh")]
    assert s["clauses"].count() == 3


def test_windows(spark):
    assert one(spark, [3, 3, 3], lambda c: W.truncated_at(c, 8), "array<int>") == 2 and one(spark, [3, 3], lambda c: W.truncated_at(c, 8), "array<int>") is None and one(spark, [], lambda c: W.truncated_at(c, 8), "array<int>") is None
    got = one(spark, ["B-X", "O"], lambda c: W.subword_labels(c, F.array(F.lit(2), F.lit(1))), "array<string>")
    assert got == ["B-X", "-100", "O"]
    toks = spark.createDataFrame([(1, i, 10 * i) for i in range(6)], "k INT, tok INT, start INT")
    secs = spark.createDataFrame([(1, 0, "A", 0, 15), (1, 1, "B", 15, 16), (1, 2, "C", 16, 40)], "k INT, ord INT, name STRING, start INT, end INT")
    assert sorted((r.name, r.lo, r.hi) for r in W.section_ranges(toks, secs, "k").collect()) == [("A", 0, 2), ("C", 2, 6)]
    at = lambda n: one(spark, "aaba", lambda c: S.occurrence(c, F.lit("a"), n))
    assert [at(1), at(2), at(3), at(4)] == [0, 1, 3, None] and one(spark, None, lambda c: S.occurrence(c, F.lit("a"))) is None


def test_sections_in_tokens(spark, sf):
    docs = spark.createDataFrame([(1, "aa b. Cc"), (2, None), (3, "  "), (4, "x y")], "k INT, t STRING")
    rows = [(1, 0, "A", 0, 3), (1, 1, "B", 3, 3), (1, 2, "C", 3, 8), (2, 0, "A", 0, 4), (3, 0, "A", 0, 2), (4, 0, "A", 2, 1), (4, 1, "B", 1, 3)]
    secs = spark.createDataFrame(rows, "k INT, ord INT, name STRING, start INT, end INT")
    want = W.section_ranges(W.tokenized(docs, "k", "t"), secs, "k").collect()
    own = docs.join(secs.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "start", "end"))).alias("s")), "k", "left")
    got = W.sections_in_tokens(own, "k", "t", F.col("s"))
    assert sorted(map(tuple, got.select(*want[0].__fields__).collect())) == sorted(map(tuple, want)) and len(want) == 3
    df = catalogue.QUERIES["section_tokens"](spark, sf)
    df.collect()
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()  # a join broadcasts all tokens where texts look small


def test_sentence_ends(spark, sf):
    texts = [None, "", " ", "Điều 1. Một; hai 1.5\n?!", "a b c. " * 150, "a " * 260 + ". b", "x. y: " * 50 + "z " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "k INT, t STRING")
    got = {r.k: r for r in W.sentence_ends(docs, "k", "t").withColumn("w", W.windows_to_ends(F.col("n"), F.col("ends"))).collect()}
    assert (got[0].n, got[0].ends, got[0].w) == (0, [], []) and (got[3].n, got[3].ends) == (11, [3, 5, 8, 10, 11])
    for r in docs.select("k", W.tokens_of("t").alias("t")).withColumn("w", W.sentence_windows(F.transform("t", lambda x: x["token"]))).collect():
        assert (got[r.k].n, got[r.k].w) == (len(r.t), r.w)
    plan = catalogue.QUERIES["sentence_windows"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "tokens_of" not in plan  # 10,000 texts' tokens would be held at once


def test_log_of_job_states(spark, tmp_path, monkeypatch):
    """The same states as the stateful operator's, over several batches, late and repeated steps, without it."""
    rng = random.Random(5)
    src, out, kept = (str(tmp_path / x) for x in ("src", "out", "kept"))
    kind, jobs = "job_id STRING, status STRING, seq BIGINT", ["a", "b", "c", "d", "e", None]
    seqs = {}
    for _ in range(4):
        rows = [(rng.choice(jobs), rng.choice(["queued", "running", "done", "error", "other", None]), rng.choice([*range(12), None])) for _ in range(30)]
        rows = list({(j, n): (j, s, n) for j, s, n in rows}.values())  # of steps with one number, the order they come in would count
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        stream.log_states(spark.readStream.schema(kind).parquet(src), out, str(tmp_path / "chk"))
        q = stream.job_states(spark.readStream.schema(kind).parquet(src)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "chk2")).trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("append").parquet(kept)).start()
        q.awaitTermination()
        got, want = (sorted((str(r.job_id), r.status, r.seq, r.events) for r in spark.read.parquet(x).collect()) for x in (out, kept))
        seqs[len(got)] = 1
        assert got == want
    assert len(got) > 6 and len(seqs) > 1

    def refused(*_):
        raise AssertionError("a Python call for each job")

    monkeypatch.setattr(stream, "advance", refused)
    spark.range(300).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") % 3 == 0, "F").otherwise("O").alias("o_orderstatus")).write.parquet(f"{tmp_path}/d/orders.parquet")
    assert {tuple(r) for r in catalogue.QUERIES["streamed_jobs"](spark, f"{tmp_path}/d").collect()} == {("error", 3, 100), ("done", 3, 200)}


def test_citations_of_chains_and_spans(spark):
    spans = [("d", "LEGAL_BASIS", 0, "điểm a, b khoản 1 Điều 173 Bộ luật Hình sự"), ("d", "LEGAL_BASIS", 50, "khoản 1 Điều 173 Bộ luật Hình sự"), ("d", "ARTICLE", 200, "Điều 9"), ("d", "CLAUSE", 190, "khoản 2"), ("d", "LAW_NAME", 210, "Bộ luật Dân sự"), ("e", "CRIME", 0, "x")]
    got = K.collected(spark.createDataFrame(spans, "doc STRING, label STRING, start INT, text STRING"), "doc").collect()
    assert sorted((r.chain, r.so_dieu, r.so_khoan, r.diem, r.law) for r in got if r.so_dieu == 173 and r.diem) == [(0, 173, 1, "a", "BLHS"), (0, 173, 1, "b", "BLHS")]
    assert [(r.chain, r.so_khoan, r.law) for r in got if r.so_dieu == 9] == [(2, 2, "BLDS")]
    v = spark.createDataFrame([("d", "BLHS2015", "found", True), ("d", "BLHS2015", "no_khoan", False), ("d", None, "no_dieu", None)], "doc STRING, law_key STRING, level STRING, in_force BOOLEAN")
    r = K.summary(v, "doc").first()
    assert (r.total, r.valid, r.not_found, r.out_of_scope, r.no_khoan, r.not_in_force, r.out_of_frame) == (3, 1, 1, 1, 1, 1, 0)


def test_verdict_counts_and_summary(spark):
    docs = spark.createDataFrame([(1,), (2,)], "k INT")
    t = spark.createDataFrame([(1, "high", 90)], "k INT, level STRING, score INT")
    e = spark.createDataFrame([(1, "not_found"), (2, "found")], "k INT, status STRING")
    c = spark.createDataFrame([(2, 3, 2, 1, 0)], "k INT, total BIGINT, valid BIGINT, not_found BIGINT, out_of_scope BIGINT")
    rows = {r.k: r for r in V.overall(docs, "k", t, e, c).collect()}
    assert rows[1].flags == ["tampering", "existence_not_found"] and rows[1].citations == "skipped"
    assert rows[2].flags == ["citations_not_found"] and rows[2].tampering == "skipped"
    n = {r.k: tuple(r)[1:] for r in C.corpus_counts(spark.createDataFrame([(1, "error"), (1, "error"), (2, "found"), (2, "error"), (2, "not_found")], "k INT, status STRING"), "k").collect()}
    assert n == {1: ("skipped", 0, 0, 0), 2: ("ok", 2, 1, 1)}
    f = spark.createDataFrame([(1, "b", "low"), (1, "a", "high"), (1, "a", "high"), (1, "c", "medium"), (1, "d", "low")], "k INT, signal STRING, severity STRING")
    assert G.summarised(f, "k").first().top == ["a", "c", "b"]
    seals = spark.createDataFrame([(1, 2, []), (2, 2, [1]), (3, 0, []), (4, 1, None)], "k INT, images INT, seal_pages ARRAY<INT>")
    assert sorted(r.k for r in G.seal_findings(seals, "k").collect()) == [1, 4]


def test_macro_and_recent(spark):
    r = spark.createDataFrame([("A", 1, 2, 2, 0.5, 0.5, 0.5), ("B", 0, 1, 0, 0.0, 0.0, 0.0), ("micro", 1, 3, 2, 0.5, 0.333333, 0.4)], "label STRING, tp BIGINT, gold BIGINT, pred BIGINT, precision DOUBLE, recall DOUBLE, f1 DOUBLE")
    m = E.with_macro(r).where("label = 'macro'").first()
    assert (m.tp, m.gold, m.f1) == (1, 3, 0.25)
    assert [x.k for x in J.recent(spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "k INT, at INT"), "at", "k", 2).collect()] == [2, 3]


def test_records_of_cases(spark):
    assert one(spark, "NỘI DUNG VỤ ÁN :\n a b \nNHẬN ĐỊNH x", C.facts_section) == "a b" and one(spark, "x" * 500, C.facts_section) == "x" * 100 and one(spark, "", C.facts_section) == ""
    r = one(spark, "Án lệ về tội giết người Điều 123", lambda c: C.metadata_record(F.lit("1/2016/AL"), c, F.lit(None).cast("string")))
    assert (r.case_type, r.articles, r.facts_summary) == ("", ["Điều 123"], "Án lệ về tội giết người Điều 123")
    spans = spark.createDataFrame([("d", "CRIME", 5, "Trộm"), ("d", "CRIME", 1, "Cướp"), ("d", "ZZZ", 0, "?"), ("d", "COURT", 0, " ")], "k STRING, label STRING, start INT, text STRING")
    assert C.fact_lines(spans, "k", [("CRIME", "Tội danh")]).first().facts == "- Tội danh: Cướp; Trộm\n- ZZZ: ?"
    rec = C.case_record(spark.createDataFrame([("d", None), ("e", "văn bản")], "k STRING, text STRING"), spans, "k", "text").collect()
    assert {x.k: (x.court, x.crimes, x.full_text) for x in rec} == {"d": ("", ["Cướp", "Trộm"], ""), "e": ("", [], "văn bản")}
    assert one(spark, "q", lambda c: C.request_body(c, "m", F.lit(""), F.lit(None).cast("string"))) == '{"model":"m","messages":[{"role":"user","content":"q"}],"stream":false,"temperature":0.2,"skip_router":true}'


def test_pdf_files_are_read():
    import zlib

    from lexicrux.plans.stores import pdf_bytes
    from lexicrux.sources.pdf import read

    got = read(pdf_bytes(5, ["Tòa án\nnhân dân", "hai", "ba"]))
    assert got["error"] is None and [p["text"] for p in got["pages"]] == ["Tòa án\nnhân dân\n", "hai\n", "ba\n"]
    assert [p["rotation"] for p in got["pages"]] == [0, 0, 90] and got["pages"][0]["fonts"] == ["Serif"] and got["pages"][0]["annots"] == ["Stamp"]
    # octal and escaped strings without a map, objects inside an object stream
    inner = b"1 0 2 36 << /Type /Catalog /Pages 2 0 R >>     << /Type /Pages /Kids [3 0 R] >>"
    body = zlib.compress(inner)
    data = b"%PDF-1.5\n9 0 obj\n<< /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode >> stream\n" + body + b"\nendstream\nendobj\n3 0 obj\n<< /Type /Page /Contents 4 0 R >>\nendobj\n4 0 obj\n<< >> stream\nBT (a\\(b\\)\\101) Tj 0 -5 Td [(c) -20 (d)] TJ ET\nendstream\nendobj\n"
    assert read(data)["pages"][0]["text"] == "a(b)A\ncd\n"
    assert read(None)["error"] == read(b"")["error"] == read(b"hello")["error"] == "not_pdf" and read(b"%PDF-1.4 nothing")["error"] == "no_pages"
    broken = pdf_bytes(1, ["x"]).replace(b"stream\n", b"stream\n\x00", 2)
    assert read(broken)["error"] in (None, "unreadable: error")


def test_chunks_are_made_once(spark):
    docs = spark.createDataFrame([("một. hai.",), ("một. hai.",), (None,), ("ba.",)], "text STRING")
    store = R.chunked(docs, "text", None)
    assert sorted(r.text for r in store.collect()) == ["ba.", "một. hai."]
    more = R.chunked(docs.union(spark.createDataFrame([("bốn.",)], "text STRING")), "text", store)
    assert sorted((r.text, r.made) for r in more.collect()) == [("ba.", "kept"), ("bốn.", "new"), ("một. hai.", "kept")]


def test_fragments_and_seals(spark):
    rows = [("a", 1, "Điều 1.", "1. Một", None, "x"), ("a", 2, "Điều 1.", "1. Một", "a) b", " "), ("a", 3, None, "2. Hai", None, None), ("b", 1, "Điều 2.", None, None, None)]
    got = {r.k: r.text for r in Files.joined_fragments(spark.createDataFrame(rows, "k STRING, p INT, h STRING, c STRING, d STRING, t STRING"), "k", "p", "h", "c", "d", "t").collect()}
    assert got == {"a": "Điều 1.\n1. Một\nx\na) b\n2. Hai", "b": "Điều 2."}
    px = spark.createDataFrame([(1, 1, bytes([200, 10, 10] * 10 + [0, 0, 0] * 90)), (1, 2, bytes([200, 190, 10] * 10)), (2, 1, None), (3, 1, b"")], "k INT, page INT, px BINARY")
    assert {r.k: (r.images, r.seal_pages) for r in G.seal_pages(px, "k", "page", "px").collect()} == {1: (2, [1]), 2: (0, []), 3: (0, [])}
