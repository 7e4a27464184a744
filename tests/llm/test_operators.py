"""Each operator against brute force or a round trip, and on nulls, empty and long texts, ties, repeats and empty tables."""

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

from lexicrux.llm import encoding, leaks, neighbours, packing, pieces, scans, setjoin, sitelines, stuffing, tokens
from lexicrux.llm.queries import oracle_sql, queries

TOKEN = re.compile(r"[^ \t\n]+")
DOC = "doc_id BIGINT, text STRING, part STRING, bin STRING, k STRING, t STRING, n STRING"  # names that clash on purpose


def docs(spark, rows, schema=DOC):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in rows], schema)


def words(rng, n):
    return " ".join(rng.choice("án phạt tù bị cáo phải trả số tiền đồng theo quy định của luật".split()) for _ in range(n))


# problem 1 -----------------------------------------------------------------------------------------------------------------
CONF = "config_id INT, tokenizer_name STRING, model_max_length BIGINT, special_tokens INT, overlap_tokens INT, text STRING"


def judgment(rng, n):
    out = []
    while sum(len(x.split()) for x in out) < n:
        out.append(words(rng, rng.randint(5, 30)).capitalize() + rng.choice([". ", ".\n", ".\n\n", "; "]))
    return "".join(out)


def test_pieces_fit_cover_and_overlap(spark):
    rng = random.Random(1)
    rows = [(1, judgment(rng, 900)), (2, "x " * 700), (3, None), (4, ""), (5, " \t\n "), (6, words(rng, 40)), (7, judgment(rng, 20_000)), (7, judgment(rng, 300)), (8, words(rng, 100)), (9, words(rng, 101))]
    conf = spark.createDataFrame([(1, "a", 102, 2, 10, "x"), (2, "b", None, 2, 10, "x"), (3, "c", 10**12, 0, 0, "x"), (4, "d", 50, None, None, "x"), (5, "e", 3, 9, 7, "x")], CONF)
    df = docs(spark, rows)
    got = pieces.split_pieces(df, conf, "doc_id", "text").collect()
    assert {(r.doc_id, r.config_id) for r in got} == {(d, c) for d, t in rows if t for c, room in ((1, 100), (4, 50), (5, 1)) if len(TOKEN.findall(t)) > room}
    texts = {d: t for d, t in rows if d != 7}
    for (d, c), room, overlap in {((r.doc_id, r.config_id), {1: 100, 4: 50, 5: 1}[r.config_id], {1: 10}.get(r.config_id, 0)) for r in got if r.doc_id != 7}:
        own = sorted((r for r in got if (r.doc_id, r.config_id) == (d, c)), key=lambda r: r.piece_no)
        assert [r.piece_no for r in own] == list(range(1, len(own) + 1))
        assert own[0].first_token == 0 and own[-1].end_token == len(TOKEN.findall(texts[d]))
        for r in own:
            assert len(TOKEN.findall(r.piece)) == r.end_token - r.first_token <= room
            assert texts[d][r.first_char : r.end_char] == r.piece
        for a, b in zip(own, own[1:]):
            assert b.shared_tokens == overlap == a.end_token - b.first_token
            if overlap:
                assert TOKEN.findall(a.piece)[-overlap:] == TOKEN.findall(b.piece)[:overlap]


def test_pieces_of_an_edited_text_stay_but_near_the_edit(spark):
    text = judgment(random.Random(3), 5000)
    other = text[:12_000] + " một câu mới được chèn vào đây. " + text[12_000:]
    conf = spark.createDataFrame([(1, "a", 202, 2, 0, "x")], CONF)
    got = [{r.piece for r in pieces.split_pieces(docs(spark, [(1, t)]), conf, "doc_id", "text").collect()} for t in (text, other)]
    assert len(got[0] - got[1]) <= 4


def test_pieces_cut_at_headings(spark):
    text = "NỘI DUNG VỤ ÁN\n" + "a b c d e f g. " * 12 + "\nNHẬN ĐỊNH\n" + "h i j k l m n. " * 12
    conf = spark.createDataFrame([(1, "a", 100, 0, 0, "x")], CONF)
    got = sorted(pieces.split_pieces(docs(spark, [(1, text)]), conf, "doc_id", "text").collect(), key=lambda r: r.piece_no)
    assert all(re.search(r"[.\n]$|^NHẬN|G$", r.piece) for r in got)


# problem 3 -----------------------------------------------------------------------------------------------------------------
VEC = "rec_no BIGINT, dim INT, vector ARRAY<FLOAT>, k STRING, v STRING"


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = [(i, 16, (v * (1 + i % 3)).astype(np.float32).tolist(), "x", "x") for i, v in enumerate(np.repeat(base, 6, 0) + rng.normal(size=(360, 16)) * 0.12)]
    rows += [(1000 + i, 16, rows[0][2], "x", "x") for i in range(4)] + [(2000 + i, 8, v.tolist(), "x", "x") for i, v in enumerate(rng.normal(size=(30, 8)).astype(np.float32))]
    rows += [(3000, 16, None, "x", "x"), (3001, 16, [0.0] * 16, "x", "x"), (3002, 16, [float("nan")] + [1.0] * 15, "x", "x"), (3003, 16, [float("inf")] + [1.0] * 15, "x", "x"), (3004, 16, [1.0] * 15, "x", "x"), (3005, None, [1.0] * 16, "x", "x"), (3006, 0, [], "x", "x"), (3007, 16, [1.0] * 15 + [None], "x", "x")]
    return rows


def brute_pairs(rows, k, least):
    out = set()
    for dim in {r[1] for r in rows if r[1]}:
        own = [(r[0], np.array(r[2], float)) for r in rows if r[1] == dim and r[2] is not None and len(r[2]) == dim and None not in r[2] and np.isfinite(np.array(r[2], float)).all() and any(r[2])]
        m = np.array([v / np.linalg.norm(v) for _, v in own])
        s = m @ m.T
        np.fill_diagonal(s, -2)
        for i in range(len(own)):
            kth = np.sort(s[i])[-k] if len(own) > k else -1
            out |= {(min(own[i][0], own[j][0]), max(own[i][0], own[j][0])) for j in np.flatnonzero((s[i] >= max(least, kth - 1e-9)) & (s[i] > -2))}
    return out


def test_similar_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 32)
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "ASKS", 90)
    rows = vectors()
    got = {tuple(r) for r in neighbours.similar_pairs(neighbours.usable(spark.createDataFrame(rows, VEC)), 5, 0.9).collect()}
    want = brute_pairs(rows, 5, 0.9)
    assert len(got & want) >= 0.97 * len(want) and not got - want


def test_similar_pairs_of_nothing_and_of_many_copies(spark):
    assert neighbours.similar_pairs(neighbours.usable(spark.createDataFrame([], VEC)), 5, 0.9).count() == 0
    same = [(i, 4, [1.0, 2.0, 3.0, 4.0], "x", "x") for i in range(40)]
    got = Counter(tuple(r) for r in neighbours.similar_pairs(neighbours.usable(spark.createDataFrame(same, VEC)), 5, 0.9).collect())
    assert got == Counter((i, j) for i in range(40) for j in range(i + 1, 40))
    # scaled copies are of cosine 1 like others
    same = [(i, 4, [float(np.float32(x * (1 + i % 7) / 3)) for x in (1.0, 2.0, 3.0, 4.0)], "x", "x") for i in range(40)] + [(90, 4, [1.0, 2.0, 3.0, 4.2], "x", "x")]
    got = Counter(tuple(r) for r in neighbours.similar_pairs(neighbours.usable(spark.createDataFrame(same, VEC)), 5, 0.9).collect())
    assert set(got) >= {(i, j) for i in range(40) for j in range(i + 1, 40)} and set(got.values()) == {1} and any(b == 90 for _, b in got)


def test_large_leaves_are_split_in_the_executors(spark, monkeypatch):
    for name, value in (("LEAF", 24), ("FITTED", 8), ("SAMPLE", 100), ("BLOCK", 20), ("ASKS", 30)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 12))
    rows = [(i, 12, v.astype(np.float32).tolist(), "x", "x") for i, v in enumerate(np.repeat(base, 4, 0) + rng.normal(size=(1200, 12)) * 0.1)]
    df = neighbours.usable(spark.createDataFrame(rows, VEC)).select("k", "v").cache()
    sample = neighbours.matrix(df.where(neighbours._part(5, 100 / 1200)).toArrow().column("v"))
    small = neighbours.Tree(sample.copy(), 1200, 24, 8, 10_000)
    before = small.leaves
    tree = neighbours._grown(df, small)
    size = Counter(r.leaf for r in neighbours._leaf_of(df, tree, 1).collect())
    assert len(size) > 1.5 * before and max(size.values()) <= 48
    got = {tuple(r) for r in neighbours.similar_pairs(neighbours.usable(spark.createDataFrame(rows, VEC)), 5, 0.9).collect()}
    want = brute_pairs(rows, 5, 0.9)
    assert len(got & want) >= 0.97 * len(want) and not got - want


def test_p3_found_has_every_copy(spark, tmp_path):
    rows = [(i, 4, [1.0, 2.0, 3.0, 4.0], "x", "x") for i in range(12)] + [(50, 4, [1.0, 2.0, 3.0, 4.1], "x", "x")]
    spark.createDataFrame(rows, VEC).write.parquet(f"{tmp_path}/precedents.parquet")
    got = {tuple(r) for r in neighbours.p3_found(spark, str(tmp_path)).collect()}
    assert got == {(i, j) for i in range(12) for j in [*range(i + 1, 12), 50]}


def test_recall_of_the_tree_on_the_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/precedents.parquet").select("rec_no", "dim", "vector").collect()]
    got = {tuple(r) for r in queries()["p3_found"](spark, sf).collect()}
    want = brute_pairs(rows, 5, 0.9)
    assert not want or len(got & want) >= 0.9 * len(want)


# problem 4 -----------------------------------------------------------------------------------------------------------------
SENTENCE = "Tòa án nhân dân huyện Bạch Đảo xét xử bị cáo về tội trộm cắp, buộc phải trả số tiền bị thiệt hại cho người bị hại."
FIELDS = "tbl STRING, k BIGINT, t STRING"


def tcvn3(s):
    back = {v: k for k, v in encoding.TCVN3.items()}
    return "".join(back.get(c, back.get(c.lower(), c)) for c in s)


def vni(s):
    back = {}
    for k, v in encoding.VNI.items():
        back.setdefault(v, k)
    return "".join(back.get(c, c) for c in s)


@pytest.fixture(scope="module")
def decoder():
    return encoding.Decoder(Counter({w.strip(encoding.LIGHT).lower(): 50 for w in (SENTENCE + " năm măng nhiệt độ đường thi hành").split()}))


@pytest.mark.parametrize("spoil", [lambda s: s.encode().decode("latin-1"), lambda s: s.encode().decode("mac_roman"), lambda s: s.encode().decode("cp437"), lambda s: s.encode().decode("latin-1").encode().decode("latin-1"), tcvn3, vni, lambda s: s.replace("ư", "ƣ")], ids=["latin-1", "mac", "cp437", "twice", "tcvn3", "vni", "oi"])
def test_wrong_decodings_are_found_and_restored(decoder, spoil):
    bad = spoil(SENTENCE)
    assert decoder.evidence(bad)
    assert decoder.restore(bad).lower() == SENTENCE.lower()


def test_lattices_let_paths_of_different_length_compete(decoder):
    known = encoding.Decoder(Counter({"đồng": 90, "ông": 30, "hàng": 20, "hướng": 5, "đường": 10, "tiếng": 40}))
    assert known.lost_letters("��ng") == "đồng" and known.lost_letters("h��ng") == "hướng"
    edges, several, lost = known.byte_lattice("ti\u00e1\ufffdng", "latin-1")
    assert several and lost and {j for j, _, n in edges[2]} == {3, 4} and all(n for _, _, n in edges[2])
    assert known.from_bytes("ti\u00e1\ufffdng", "latin-1")[0] == "tiếng" and known.from_bytes("ti\u00e1ng", "latin-1") is None
    assert known.from_bytes("abc", "latin-1") is None
    again = __import__("pickle").loads(__import__("pickle").dumps(known))
    assert again.lost_letters("��ng") == "đồng"


def test_partly_wrong_and_lost(decoder):
    words_ = SENTENCE.split()
    words_[4] = words_[4].encode().decode("latin-1")
    assert decoder.restore(" ".join(words_)) == SENTENCE
    assert decoder.evidence(SENTENCE.replace("huyện", "huy?n")) and decoder.restore(SENTENCE.replace("huyện", "huy?n")) == SENTENCE
    assert decoder.evidence(SENTENCE.replace("ộ", "�"))


@pytest.mark.parametrize("fine", [SENTENCE, "Brûlée, Bäckerei Grün, d’Août, «Là Côte»", "35 °C ± 2 °C, 1.250 m², 12 × 30 cm, § 12, № 18, © Bản quyền", "näm, mäng, tr€n, đấ† và thá­\nch, thá¬\nch", "", "   ", "Có gì không?Có.", "a" * 100_000])
def test_what_is_no_wrong_decoding(decoder, fine):
    assert decoder.evidence(fine) == []
    assert decoder.restore(fine) == fine


def test_damaged_over_tables(spark):
    rows = [("precedents", i, SENTENCE) for i in range(5)] + [("precedents", 7, SENTENCE.encode().decode("latin-1")), ("ocr_results", 7, tcvn3(SENTENCE)), ("ocr_results", 7, tcvn3(SENTENCE)), ("ocr_results", 8, "")]
    got = encoding.damaged(spark.createDataFrame(rows, FIELDS), restore=True).collect()
    assert Counter((r.tbl, r.k) for r in got) == {("precedents", 7): 1, ("ocr_results", 7): 2}
    assert all(r.restored.lower() == SENTENCE.lower() for r in got)
    assert encoding.damaged(spark.createDataFrame([], FIELDS)).count() == 0


# problem 5 -----------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def editor(decoder):
    text = " ".join([SENTENCE] * 3)
    counts = Counter({w.strip(encoding.LIGHT).lower(): 50 for w in text.split()})
    lines = "\n".join([SENTENCE, "Theo biên bản số 5018/2014/TB-TA lập ngày 09-01-2012, xe 28Đ5-93561 trị giá 19.043.795đ.", "Chủ tọa và hai Hội thẩm; lập tại trang 3 của hồ sơ.", "phải trả trong tháng", "5.", SENTENCE] * 3)
    return scans.Editor(encoding.Decoder(counts), [lines] * 60)


def test_noise_of_scans(editor):
    page = SENTENCE + "\n"
    assert editor.kinds(page * 3) == []
    assert editor.kinds(page.replace("huyện", "huy-\nện")) == ["hyphen"]
    assert editor.kinds(page.replace("huyện", "huy\xad\n ện")) == ["hyphen"]
    assert editor.kinds("Thẩm phán -\nChủ tọa") == []
    assert "running" in editor.kinds((page * 2 + "- 2 -\n") * 3)
    assert "running" in editor.kinds((page * 2 + "trang 2\n") * 3)
    assert editor.kinds("bị cá0 phải †rả số †iền 6ị hại") == ["misread"]
    assert editor.kinds("bị cá0 phải †rả số tiền bị hại") == []
    assert editor.kinds("xe 28Đ5-93561, số 5018/2014/TB-TA, 19.043.795đ, 5m, (tiền), tội!") == []
    assert editor.kinds(SENTENCE.encode().decode("latin-1") + "\n- 2 -\n") == []
    assert editor.kinds("") == [] and editor.kinds("x" * 100_000) == []


def test_headers_without_a_number_and_long_ones(decoder):
    rng = random.Random(4)
    prose = lambda n: "\n".join(words(rng, rng.randint(12, 40)).capitalize() + "." for _ in range(n))
    editor = scans.Editor(decoder, [prose(12) for _ in range(400)])
    own = prose(8).split("\n")
    for head in ("Tòa án nhân dân huyện Bạch Đảo", "Tòa án nhân dân huyện Bạch Đảo, bản án của vụ án hình sự sơ thẩm xét xử công khai tại trụ sở của tòa án này"):
        lines = []
        for x in own:
            half = x.split(" ")
            lines += [" ".join(half[:6]), head, " ".join(half[6:])]
        found = editor.furniture_lines("\n".join(lines))
        assert set(found) <= set(range(1, 24, 3)) and len(found) >= 6
    assert editor.furniture_lines("\n".join(own)) == []


def test_scan_is_repaired(editor):
    page = "Tòa án nhân dân huyện Bạch Đảo xét xử bị cáo về tội trộm cắp, buộc\nphải †rả số tiền bị thi-\nệt hại cho n9ười bị hại."
    assert editor.repair(page + "\n- 2 -\n" + page) == SENTENCE + "\n" + SENTENCE


def test_breaks_are_decided_by_the_editor(editor):
    """Break marks and line ends are characters of the perceptron: halves that are counted as words don't keep a word apart."""
    counts = Counter({w: 50 for w in editor.log}) + Counter({"ng": 20, "oạn": 20})
    again = scans.Editor(encoding.Decoder(counts), ["\n".join([SENTENCE, SENTENCE])] * 60)
    assert again.kinds(SENTENCE.replace("huyện", "huyện Ng-\noạn")) == ["hyphen"]
    assert again.kinds("bị cáo Bạch Đảo -\nNgười bị hại") == []
    assert "hyphen" not in again.kinds("theo biên bản số 01/2020/HS-\nST của tòa án")
    assert any(f.startswith("j:") for f in again.chars.w) and any(f.startswith("e:") for f in again.chars.w)


def test_stray_marks_and_lost_blanks_are_no_misread_letters(editor):
    assert editor.edit_token("ph|ải") == "phải" and editor.misread("ph|ải ph|ải ph|ải") == 0
    assert editor.edit_token("tiềnthiệt") == "tiền thiệt" and editor.edit_token("phải") == "phải"
    assert editor.edit_token("n9ười") == "người" and editor.misread("n9ười n9ười n9ười") == 3


def test_held_out_accuracy_of_the_editor(editor):
    rng = random.Random(9)
    right = total = 0
    for w in sorted(editor.log):
        if len(w) > 2 and any(c in scans.CONFUSIONS for c in w):
            for _ in range(5):
                bad, *_ = scans.damaged(w, rng)
                total += 1
                right += editor.edit_token(bad) == w
    assert right / total > 0.9


def test_noisy_over_tables(spark):
    rows = [("precedents", i, SENTENCE) for i in range(5)] + [("ocr_results", 1, SENTENCE.replace("huyện", "huy-\nện")), ("ocr_results", 2, None), ("ocr_results", 3, " ")]
    got = scans.noisy(spark.createDataFrame(rows, FIELDS).where("t IS NOT NULL")).collect()
    assert [(r.k, r.kinds) for r in got] == [(1, ["hyphen"])]
    assert scans.noisy(spark.createDataFrame([], FIELDS)).count() == 0


# problem 6 -----------------------------------------------------------------------------------------------------------------
SETS = "rec_no BIGINT, crimes ARRAY<STRING>, articles ARRAY<STRING>, rep STRING, toks STRING, k STRING, n STRING"


def canonical(x):
    return re.sub(r"(?<!\d)0+(?=\d)", "", " ".join(unicodedata.normalize("NFC", x).lower().split()))


def test_similar_sets_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        if i % 3 and rows and rng.random() < 0.7:
            a = list(rng.choice(rows)[2] or [])
            for _ in range(rng.randint(0, 2)):
                a[rng.randrange(len(a)) if a else 0 :] = a[1:] if a else []
                a.append(f"Điều {rng.randint(1, 80)}")
        else:
            a = [f"Điều {rng.randint(1, 80)}" for _ in range(rng.randint(8, 20))]
        rows.append((i, [" Trộm  CẮP", None, "", "  "] if i % 2 else None, a, "x", "x", "x", "x"))
    rows += [(1000 + i, ["Cướp"], [f"điều 0{j}" for j in range(1, 12)], "x", "x", "x", "x") for i in range(5)] + [(2000, [], None, "x", "x", "x", "x"), (2001, None, None, "x", "x", "x", "x")]
    s = {r[0]: {canonical(x) for xs in r[1:3] if xs for x in xs if x is not None} - {""} for r in rows}
    s = {k: v for k, v in s.items() if len(v) >= 10}
    want = {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) * 5 >= 4 * len(s[a] | s[b])}
    pairs, members = setjoin.similar_sets(spark.createDataFrame(rows, SETS), "rec_no", ["crimes", "articles"])
    assert {tuple(r) for r in setjoin.expanded(pairs, members, "rec_no").collect()} == want


@pytest.mark.parametrize("n", [1, 2, 3])
def test_every_prefix_length_finds_all(spark, n):
    rng = random.Random(n)
    sets = [sorted(rng.sample(range(30), rng.randint(10, 14))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(sets)), "rep BIGINT, toks ARRAY<BIGINT>")
    keys = {}
    for r in setjoin.keyed(df, n).collect():
        keys.setdefault(r.key, set()).add(r.rep)
    met = {(a, b) for v in keys.values() for a in v for b in v if a < b}
    need = {(a, b) for a in range(60) for b in range(a + 1, 60) if len(set(sets[a]) & set(sets[b])) * 5 >= 4 * len(set(sets[a]) | set(sets[b]))}
    assert need <= met


def test_large_groups_of_copies_are_whole(spark, monkeypatch):
    from lexicrux.llm import copies

    monkeypatch.setattr(copies, "BLOCK", 64)
    monkeypatch.setattr(setjoin, "HOT", 3)
    rows = [(i, None, [f"Điều {j}" for j in range(1, 12)], "x", "x", "x", "x") for i in range(200)] + [(500 + i, [f"Cướp {i}"], [f"Điều {j}" for j in range(1, 12)], "x", "x", "x", "x") for i in range(9)]
    pairs, members = setjoin.similar_sets(spark.createDataFrame(rows, SETS), "rec_no", ["crimes", "articles"])
    assert pairs.count() == 9 * 10 // 2
    got = Counter(tuple(r) for r in setjoin.expanded(pairs, members, "rec_no").collect())
    ids = [r[0] for r in rows]
    assert got == Counter((a, b) for a in ids for b in ids if a < b)
    pairs, members = setjoin.similar_sets(spark.createDataFrame([], SETS), "rec_no", ["crimes", "articles"])
    assert setjoin.expanded(pairs, members, "rec_no").count() == 0


# problem 7 -----------------------------------------------------------------------------------------------------------------
LINES = "rec_no BIGINT, court STRING, full_text STRING, site STRING, line STRING, k STRING, t STRING"


def test_repeated_lines_against_brute_force(spark):
    rng = random.Random(4)
    shared = [f"Bản quyền thuộc về tòa án số {i} của tỉnh này, giữ toàn quyền" for i in range(6)]
    rows = []
    for i in range(80):
        ls = [words(rng, 12) for _ in range(5)] + [rng.choice(shared).replace(" ", rng.choice([" ", "  ", "\t"])).upper() if rng.random() < 0.5 else rng.choice(shared)] * rng.randint(0, 2)
        rng.shuffle(ls)
        rows.append((i, rng.choice(["A", "B", None, "", "Tòa C"]), "\n".join([" ngắn ", *ls]), "x", "x", "x", "x"))
    rows += [(100, "A", None, "x", "x", "x", "x"), (101, "A", "", "x", "x", "x", "x"), (0, *rows[0][1:])]
    norm = lambda x: re.sub("[ \t]+", " ", x).strip(" ").lower()
    seen = {}
    for r in rows:
        for x in (r[2] or "").split("\n"):
            if r[1] is not None and r[2] is not None:
                seen.setdefault((r[1], norm(x)), set()).add(r[0])
    want = {(r[0], i) for r in rows if r[1] is not None and r[2] is not None for i, x in enumerate(r[2].split("\n"), 1) if len(norm(x)) >= 30 and len(seen[r[1], norm(x)]) >= 4}
    df = spark.createDataFrame(rows, LINES)
    got = sitelines.repeated(df)
    assert {tuple(r) for r in got.collect()} == want
    clean = {r.rec_no: r.clean_text for r in sitelines.without(df.dropDuplicates(["rec_no"]), got).collect()}
    for r in rows[:80]:
        assert clean[r[0]] == "\n".join(x for i, x in enumerate(r[2].split("\n"), 1) if (r[0], i) not in want)
    assert sitelines.repeated(spark.createDataFrame([], LINES)).count() == 0


def test_lines_with_changing_fields_have_one_template(spark):
    rng = random.Random(14)
    names = [f"{a} {b}" for a in "lan hoa mai cúc trúc đào sen huệ liên ngọc".split() for b in "an bình chi dung giang hà khánh linh minh nga".split()]
    notice = lambda i: f"Trang này do cán bộ {names[i % 100]} của tòa án đăng ngày {i % 28 + 1}/3/2020, xin liên hệ với văn phòng"
    rows = [(i, "A", "\n".join([words(rng, rng.randint(8, 14)), notice(i), words(rng, 12)]), "x", "x", "x", "x") for i in range(100)]
    df = spark.createDataFrame(rows, LINES)
    assert sitelines.repeated(df).count() == 0  # no line is there twice
    under = sitelines.templated(df).where("fixed >= 0.6").collect()
    assert {(r.rec_no, r.line_no) for r in under} == {(i, 2) for i in range(100)}
    assert len({r.template for r in under}) < 40 and all(r.docs >= 4 for r in under)
    again = sitelines.templated(df.repartition(7)).where("fixed >= 0.6").collect()
    assert sorted((r.rec_no, r.line_no, r.template, r.docs) for r in again) == sorted((r.rec_no, r.line_no, r.template, r.docs) for r in under)


# problem 8 -----------------------------------------------------------------------------------------------------------------
def test_packing(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(1, 90))) for i in range(400)] + [(900, None), (901, ""), (902, words(rng, 100)), (903, words(rng, 101)), (904, words(rng, 1000)), (5, words(rng, 20))]
    got = packing.pack(docs(spark, rows), "doc_id", "text", 100).collect()
    assert Counter(r.doc_id for r in got if r.piece_no == 1) == Counter(i for i, _ in rows)
    assert {r.doc_id for r in got if r.pieces > 1} == {903, 904}
    fill = Counter()
    for r in got:
        fill[r.container] += r.tokens
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(len(TOKEN.findall(t or "")) for _, t in rows)
    assert len(fill) <= 1.1 * math.ceil(sum(fill.values()) / 100)
    assert packing.pack(docs(spark, []), "doc_id", "text", 100).count() == 0


def test_packing_holds_few_items_at_once(spark):
    """Items that leave much room: windows that had to go are final, only those open at the end are merged."""
    rows = [(i, "x " * 110) for i in range(3000)] + [(5000 + i, None) for i in range(500)] + [(6000 + i, "x " * 200) for i in range(10)]
    got = packing.pack(docs(spark, rows).repartition(2), "doc_id", "text", 200).collect()
    assert len(got) == len(rows) and len({r.container for r in got if r.tokens}) == 3010
    assert sum(r.container.startswith("m") and r.tokens > 0 for r in got) <= 2 * packing.OPEN
    w, rng = packing.Windows(100, 8), random.Random(3)
    assert all(w.place(rng.randint(1, 100)) and len(w.open) <= 8 for _ in range(2000))


def test_token_counts():
    import pyarrow as pa

    texts = ["a b", None, "", " x\t\ny z  ", "đồng", "\n"]
    assert tokens.counts(pa.array(texts, pa.string())).tolist() == [len(TOKEN.findall(t or "")) for t in texts]
    assert tokens.counts(pa.array(texts, pa.string()).slice(3)).tolist() == [2, 1, 0]


# problem 9 -----------------------------------------------------------------------------------------------------------------
def fold(text):
    s = "".join(c for c in unicodedata.normalize("NFD", text.lower().replace("đ", "d")) if unicodedata.category(c)[0] != "M")
    return re.findall(r"[^\W_]+", s)


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vocab = "thuyền bến chợ gạo muối lò gốm đò ná tre mộc sen rơm".split()
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40)))) for i in range(25)] + [(99, None), (98, ""), (3, "bản ghi khác dưới cùng số")]
    pages = []
    for i in range(60):
        t = items[rng.randrange(25)][1].split()
        a = rng.randint(0, max(0, len(t) - 5))
        part = t[a : a + rng.randint(5, 20)]
        shown = rng.choice([" ", "\n> ", " – ", ", "]).join(rng.choice([w, w.upper(), unicodedata.normalize("NFD", w)]) for w in part)
        pages.append((i, " ".join(rng.choice(vocab) for _ in range(20)) + ". Trang web " + shown + " hết"))
    pages += [(200, None), (201, ""), (202, "a" * 100_000), (0, pages[0][1])]
    grams = lambda ws: {tuple(ws[i : i + 12]) for i in range(len(ws) - 11)}
    want = {(p, i) for p, t in pages if t for i, s in items if s and grams(fold(t)) & grams(fold(s))}
    it = spark.createDataFrame([(i, s, "x") for i, s in items], "item_id BIGINT, text STRING, k STRING")
    got = leaks.leaked(docs(spark, pages), it)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    clean = {r.doc_id: r for r in leaks.cleaned(docs(spark, pages), it, drop_share=1.0).collect()}
    assert all(not any(grams(fold(clean[p].clean_text)) & grams(fold(s)) for _, s in items if s) or clean[p].removed_words for p, t in pages if t)
    assert clean[200].clean_text is None and clean[201].clean_text == ""
    one = {(r.doc_id, r.clean_text, r.removed_words) for r in leaks.cleaned(docs(spark, pages), it).collect()}
    monkeypatch.setattr(leaks, "MOST_WORDS", 200)  # several automata, one after the other
    assert sum(1 for _ in leaks.automata(it, "item_id", "text", 12)) > 3
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(docs(spark, pages), it).collect()} == want
    assert {(r.doc_id, r.clean_text, r.removed_words) for r in leaks.cleaned(docs(spark, pages), it).collect()} == one
    assert leaks.leaked(docs(spark, []), it).count() == 0
    assert leaks.leaked(docs(spark, pages), it.limit(0)).count() == 0


# problem 10 ----------------------------------------------------------------------------------------------------------------
def test_stuffed_pages(spark):
    rng = random.Random(10)
    say = lambda: rng.choice(["Bị cáo phải trả cho người bị hại số tiền {} đồng theo quy định của pháp luật.", "Tại phiên tòa ngày {}, đại diện của cơ quan này cho rằng việc đó là không có cơ sở.", "Người liên quan có cho bị cáo mượn {} đồng vì thua lỗ, nay không đòi lại khoản này."]).format(rng.randint(1, 999))
    prose = [(i, " ".join(say() for _ in range(12))) for i in range(80)]
    spam = [(100, "luật sư giỏi giá rẻ " * 40), (101, "\n".join(f"[thuê luật sư](https://a.example/{i})" for i in range(30))), (102, "#a_b #c_d #e_f #gh " * 30), (103, "\n".join(f"dấu tên khắc – {i}.000đ – giảm {i}% – mã X{i} – tag: rẻ, đẹp" for i in range(30)))]
    rows = [*prose, *spam, (200, None), (201, ""), (202, " \n "), (100, spam[0][1])]
    got = {r.doc_id: r.stuffing for r in stuffing.stuffed(docs(spark, rows)).collect()}
    assert {k for k, v in got.items() if v > stuffing.SHARE} == {100, 101, 102, 103}
    assert set(got) == {i for i, t in rows if t and t.strip()}
    assert stuffing.stuffed(docs(spark, [])).count() == 0


# all -----------------------------------------------------------------------------------------------------------------------
def test_every_query_runs_and_equals_its_sql(spark, sf):
    import glob
    import os

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert {f"p{n}_found" for n in (1, 3, 4, 5, 6, 7, 8, 9, 10)} <= set(queries())
    for name, q in queries().items():
        df = q(spark, sf)
        rows = Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect()) if name in oracle_sql() else df.count()
        if name in oracle_sql():
            want = con.sql(oracle_sql()[name])
            at = [want.columns.index(c) for c in sorted(df.columns)]
            assert rows == Counter(tuple(r[i] for i in at) for r in want.fetchall()), name
