"""Page cleaning, printed numbers, volume alignment, registries, snapshots of ranges."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import audit, pages, providers, upsert, volumes


def one(spark, column, x):
    return spark.createDataFrame([(x,)], "x string").select(column).first()[0]


def test_indented_paragraphs():
    layout = "\n".join([" " * 10 + "First para begins", "and goes on", "", " " * 30 + "HEADING", "", " " * 9 + "Second para here", " " * 700 + "12", "ends.", "", "1 a note", "that is left out"])
    assert pages.indented_paragraphs(layout) == ["First para begins and goes on", "Second para here ends."]
    assert pages.indented_paragraphs(" " * 10 + "A HEADING IN CAPITALS") == [] and pages.indented_paragraphs("") == []


def test_parts_in_python(spark):
    df = spark.createDataFrame([(1, "a\n\n" + "b" * 50 + "\n\nc"), (2, None)], "k long, t string")
    assert [(r["k"], r["part"]) for r in pages.in_python(df, "k", "t", pages.merged_paragraphs).collect()] == [(1, "a " + "b" * 50 + " c")]
    assert pages.merged_paragraphs("x" * 40 + "\n" + "y" * 45) == ["x" * 40, "y" * 45]


def test_joins_of_fragments():
    known, sure, kept, common = {"khong", "lan", "nhan", "la", "n"}, {"thai"}, {("này", "āvuso")}, {"la"}
    ok = lambda *p: pages.joins(p, known, sure, kept, common)
    assert ok("kho", "ng") and ok("th", "ai") and ok("Moggall", "āna") and not ok("Này", "āvuso") and not ok("la", "n") and not ok("vi", "ananda") and ok("sikh", "ī")
    assert pages.mended("kho ng la", known) == "khong la"


def test_running_heads_and_notes(spark):
    assert one(spark, pages.without_running_head(F.col("x")), "\n 12\nTitle line\nbody") == "body" and one(spark, pages.without_running_head(F.col("x")), "12\n3. verse\nbody") == "3. verse\nbody"
    page = "Trường Bộ 12\n45\nFirst line\nof a paragraph\n\nphẩm x - giảng\nSecond"
    assert one(spark, pages.clean_page(F.col("x"), ["trường bộ"], [("^phẩm .+ - giảng", "")]), page) == "First line of a paragraph\n\nSecond"
    assert one(spark, pages.clean_page(F.col("x"), [], [("^head", "kept")]), "head gone\nhead kept") == "head kept"
    assert one(spark, F.array_join(pages.lines(F.col("x"), r"^\[", "^Sub "), "|"), "<p>a  b</p><p>[noise]</p>Sub title<br>c &amp; d") == "a b|c & d"


def test_works_are_split_by_numerals(spark):
    html = "<p>front</p><p>I. One (S.1)</p><p>a</p><p>II. Two</p><p>I. Next</p><p>b</p>"
    got = pages.split_works(spark.createDataFrame([("c", 1, html), ("c", 2, "<p>still next</p>")], "k string, p long, h string"), "k", "p", "h").orderBy("group", "index").collect()
    assert [(r["group"], r["index"], r["printed"], r["text"]) for r in got] == [(1, 1, 1, "One (S.1)\na"), (1, 2, 2, "Two"), (2, 1, 1, "Next\nb\nstill next")]


@pytest.mark.parametrize("line, want", [("5. 2. 1. KOSIYA", 1), ("(12). X", 12), ("VI. LOKUTTARA", 6), ("xx) y", 20), ("No number", None), ("MMM. z", None)])
def test_printed_numbers(spark, line, want):
    assert one(spark, pages.printed_number(F.col("x")), line) == want
    assert one(spark, pages.numbers_agree(F.col("x"), F.lit("1. Kosiya")), line) is (want == 1)


def test_spacing_audit_finds_broken_words(spark):
    df = spark.createDataFrame([(1, "kh ông tốt"), (2, "không tốt không"), (3, "đã đến. rồi đi")], "k long, t string")
    got = {(r["left"], r["right"]): (r["no_vowel"], r["joined"]) for r in pages.spacing_audit(df, "k", "t").collect()}
    assert got == {("kh", "ông"): (True, 2)}
    assert pages.spacing_audit(df, "k", "t", [("kh", "ông")]).count() == 0


def test_kinds_of_texts(spark):
    assert one(spark, pages.vietnamese(F.col("x")), "ấ" * 31) and not one(spark, pages.vietnamese(F.col("x")), "ấ" * 30)
    assert one(spark, pages.compact(F.col("x")), "suta ṃ ā-vuso 12") == "sutamavuso"
    assert one(spark, pages.aliased_stem(F.col("x"), F.lit("v"), {("v", "a"): "b", ("w", "c"): "d"}), "a") == "b" and one(spark, pages.aliased_stem(F.col("x"), F.lit("v"), {("w", "c"): "d"}), "c") == "c"


def test_increasing_path_against_all_choices():
    rng = np.random.default_rng(0)
    for _ in range(20):
        score = rng.integers(0, 9, (3, 6)).astype(float)
        at = volumes.monotone_path(score)
        assert (np.diff(at) > 0).all() and score[np.arange(3), at].sum() == max(sum(score[i, c] for i, c in enumerate(x)) for x in itertools.combinations(range(6), 3))
    assert volumes.monotone_path(np.ones((3, 2))) is None


def test_gapped_path_against_all_choices():
    rng = np.random.default_rng(1)
    for _ in range(20):
        score = rng.random((3, 5))
        c = score - score.mean(1, keepdims=True)
        worth = lambda x: sum(c[i, j] for i, j in enumerate(x)) - 0.05 * sum(max(0, b - a - 1) for a, b in zip(x, x[1:]))  # noqa: E731, B023
        at = volumes.gapped_path(score)
        assert (np.diff(at) >= 0).all() and worth(at.tolist()) == pytest.approx(max(map(worth, (x for x in itertools.product(range(5), repeat=3) if x[0] <= x[1] <= x[2]))))


def test_anchors(spark):
    scores = spark.createDataFrame([("v", u, c, s) for u, row in enumerate([[9, 1, 0, 0], [8, 7, 1, 0], [0, 0, 1, 2]]) for c, s in enumerate(map(float, row))], "volume string, unit long, candidate long, score double")
    got = {r["unit"]: (r["candidate"], r["weak"]) for r in volumes.anchor_path(scores, "volume", 3.0).collect()}
    assert got == {0: (0, False), 1: (1, False), 2: (3, True)}
    fixed = spark.createDataFrame([("v", 1, 2)], "volume string, unit long, candidate long")
    between = {r["unit"]: r["candidate"] for r in volumes.between_anchors(scores, fixed, "volume").collect()}
    assert between == {0: 0, 1: 2, 2: 3}


def test_headings_blocks_and_ends(spark):
    units = spark.createDataFrame([("v", 1, "1. Ajitasuttaṃ", "ajitasuttam"), ("v", 2, "2. Puṇṇakasuttaṃ", "punnakasuttam"), ("v", 3, "3. Metteyyasuttaṃ", "metteyyasuttam")], "volume string, unit long, title string, stem string")
    lines = spark.createDataFrame([("v", 5, "1. AJITASUTTAM", "ajitasuttam"), ("v", 7, "2. PUNNAKKASUTTAM", "punnakkasuttam"), ("v", 9, "7. METEYYASUTTAM", "meteyyasuttam")], "volume string, page long, line string, stem string")
    assert sorted((r["unit"], r["page"]) for r in volumes.find_headings(units, lines, "volume").collect()) == [(1, 5), (2, 7)]  # 3 has another number
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["GREAT", "TITLE", "", "body", "NEXT"])], "page long, at long, t string")
    blocks = volumes.heading_blocks(rows, "page", "at", "t")
    assert [(r["block"], r["heading"]) for r in blocks.orderBy("block").collect()] == [(1, "GREAT TITLE"), (2, "NEXT")]
    facing = volumes.heading_blocks(rows.withColumn("page", F.lit(2).cast("long")), "page", "at", "t")
    assert volumes.heading_pairs(blocks, facing, "page").count() == 2 and volumes.heading_pairs(blocks, facing.filter("block = 1"), "page").count() == 0
    ends = spark.createDataFrame([("v", 8, "Paṭhamabhāṇavāro niṭṭhito."), ("v", 12, "x\nDasuttarasuttaṃ Niṭṭhitaṃ."), ("w", 3, "niṭṭhitaṃ")], "volume string, page long, t string")
    assert sorted(map(tuple, volumes.last_boundary(ends, "volume", "page", "t", F.lit("dasuttarasuttam")).collect())) == [("v", 13, True), ("w", 4, False)]


def test_heading_offsets(spark):
    page = "CHAPTER\n5. 2. 1. FIRST RULE\nbody text\n2. SECOND RULE"
    at = lambda n, x=page: one(spark, volumes.heading_offset(F.col("x"), F.lit(n).cast("int")), x)
    assert tuple(at(2)) == (page.index("2. SECOND"), "2. SECOND RULE") and at(1)["at"] == 8 and at(9) is None and at(None)["line"] == "2. SECOND RULE"
    assert at(9, "body\nONLY HEADING\nbody")["line"] == "ONLY HEADING"


def test_numbered_paragraphs_of_pages(spark):
    df = spark.createDataFrame([("v", 1, "front\n1. 2. a\nmore\n3. b"), ("v", 9, "4. late")], "volume string, page long, t string")
    got = volumes.numbered_candidates(df, "volume", "page", "t", last=F.lit(9)).orderBy("line").collect()
    assert [(r["line"], r["numbers"], r["block"]) for r in got] == [(1, [1, 2], "1. 2. a more"), (3, [3], "3. b")]
    right = spark.createDataFrame([("v", 2, 7, [1, 2]), ("v", 2, 9, [3])], "volume string, page long, line int, numbers array<int>")
    left = volumes.numbered_candidates(df, "volume", "page", "t").select("volume", "page", "line", "numbers")
    assert sorted((r["line"], r["facing_line"]) for r in volumes.nth_occurrence(left.filter("page = 1"), right, "volume", "page").collect()) == [(1, 7), (3, 9)]


def test_registry_turns_and_cache(spark):
    calls = []
    fail = lambda t: calls.append("f") or 1 / 0
    ask = providers.in_turn([fail, lambda t: [f"{x}!" for x in t]])
    assert ask(["a"]) == ["a!"] and ask(["b"]) == ["b!"] and calls == ["f", "f"]
    with pytest.raises(RuntimeError):
        providers.in_turn([fail])(["x"])
    now = [0.0]
    cache = providers.ResultCache(2, 10, lambda: now[0])
    cache.put("a", 1), cache.put("b", 2), cache.get("a"), cache.put("c", 3)
    assert cache.get("b") is None and cache.get("a") == 1
    now[0] = 11
    assert cache.get("a") is None


def test_snapshots_of_ranges(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    path = str(tmp_path / "t")
    upsert.staged_write(rows, path)
    upsert.staged_write(rows.filter("id = 1"), path)
    assert [r["id"] for r in spark.read.parquet(path).collect()] == [1] and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t"]
    changed = upsert.backup_then_update(rows, str(tmp_path / "b"), ["id"], {"text": F.when(F.col("id") == 2, "c").otherwise(F.col("text"))})
    assert sorted(map(tuple, changed.collect())) == [(1, "a"), (2, "c")] and [tuple(r) for r in spark.read.parquet(str(tmp_path / "b")).collect()] == [(2, "b")]
    with pytest.raises(Exception):
        upsert.backup_then_update(rows, str(tmp_path / "b"), ["id"], {"text": F.lit("z")})
    moves = spark.createDataFrame([(1, 5, "move"), (2, 6, "blocked")], "id long, to long, action string")
    with pytest.raises(ValueError):
        upsert.apply_repoint(rows.withColumn("p", F.lit(0).cast("long")), moves, "id", "p")
    assert upsert.without(rows, [1], "id").count() == 1 and upsert.without(rows, [], "id").count() == 0


def test_reports(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.random()) for _ in range(41)]
    df = spark.createDataFrame(rows, "m string, f double")
    for r in audit.method_summary(df, "m", "f", "a").collect():
        own, control = sorted(f for m, f in rows if m == r["m"]), np.median([f for m, f in rows if m == "a"])
        assert r["p25"] == own[len(own) // 4] and r["weak"] == sum(f < control * 0.6 for f in own) and r["median"] == pytest.approx(np.median(own))
    units = spark.createDataFrame([("mul", "f", 5, True), ("mul", "g", 7, False), ("att", "g", 2, False)], "c string, file string, n long, ok boolean")
    by, files = audit.unit_report(units, "c", "file", F.col("n"), F.col("ok"))
    assert {(r["c"], r["passages"], r["missed"]) for r in by.collect()} == {("mul", 12, 7), ("att", 2, 2), (None, 14, 9)} and [tuple(r) for r in files.collect()] == [("g", 9)]
