import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import similarity as S
from loomtext.operators import align, audit, providers, ranges, ranking, retrieval, upsert
from loomtext.plans import catalog


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def sections(spark):
    data = [("p", "d", ["b"], 0, 99), ("x", "d", ["b", "x"], 0, 3814), ("y", "d", ["b", "y"], 29, 60), ("z", "d", ["b", "x", "z"], 5, 9), ("w", "d", ["b", "x", "w"], 10, None)]
    return spark.createDataFrame(data, "id string, doc string, path array<string>, start long, end long")


def test_clip_only_at_strangers(spark):
    got = {r["id"]: (r["end"], r["clipped"]) for r in ranges.clip_overreach(sections(spark), "doc").collect()}
    assert got == {"p": (99, False), "x": (28, True), "y": (60, False), "z": (9, False), "w": (10, False)}


def test_outline_and_ancestor(spark):
    s = sections(spark)
    assert {(r["parent"], r["child"]) for r in ranges.outline(s, "doc").collect()} == {("x", "z"), ("x", "w"), ("p", "z"), ("p", "w")}
    got = {r["id"]: r["ancestor"] for r in ranges.smallest_ancestor(s, "doc", F.size("path") <= 2).collect()}
    assert got == {"p": "p", "x": "x", "y": "y", "z": "p", "w": "p"}


def test_ranges_against_brute_force(spark):
    rng = random.Random(3)
    a = [(i, rng.randrange(3), s := rng.randrange(300), s + rng.randrange(150)) for i in range(60)]
    df = spark.createDataFrame(a, "id long, doc long, start long, end long")
    points = spark.createDataFrame([(d, p) for d in range(3) for p in range(0, 460, 7)], "doc long, at long")
    want = sorted((d, p, i) for d in range(3) for p in range(0, 460, 7) for i, e, x, y in a if e == d and x <= p <= y)
    assert rows(ranges.point_in_range(points, df, "doc", "at").select("doc", "at", "id")) == want
    pairs = sorted((i[0], j[0]) for i in a for j in a if i[1] == j[1] and i[2] <= j[3] and i[3] >= j[2])
    assert rows(ranges.overlaps(df, df, "doc").select("a_id", "b_id")) == pairs


def test_islands_blocks_and_numbers(spark):
    df = spark.createDataFrame([(1, i, v, t) for i, v, t in [(0, "p", "a"), (1, "v", "b"), (2, "v", " c "), (3, "v", " "), (5, "v", "d"), (6, None, "e")]], "k long, at long, v string, t string")
    assert rows(ranges.islands(df.filter("at < 6"), "k", "at", "v").select("start", "end", "n")) == [(0, 0, 1), (1, 3, 3), (5, 5, 1)]
    blocks = ranges.merge_blocks(df, "k", "at", "at", "t", F.col("v").eqNullSafe("v")).orderBy("start").collect()
    assert [(b["ids"], b["text"]) for b in blocks] == [([0], "a"), ([1, 2, 5], "b\nc\nd"), ([6], "e")]
    numbered = ranges.numbered_in_group(df, "k", "at", F.col("t") == "b").orderBy("at").collect()
    assert [(r["group_no"], r["number"]) for r in numbered] == [(0, 1), (1, 0), (1, 1), (1, 2), (1, 3), (1, 4)]


def test_merge_by_source_counts_gaps_at_both_ends(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 2, "z"), ("b", 2, "only")], "source string, at long, text string").withColumn("n", F.lit(3))
    got = {r["source"]: (r["text"], r["missing"], r["percent"]) for r in ranges.merge_by_source(df, ["source"], F.col("n")).collect()}
    assert got == {"a": ("x\n\nz", 1, 67), "b": ("only", 2, 33)}


def test_prune_path(spark):
    assert spark.range(1).select(ranges.prune_path(F.array(*map(F.lit, ["A", "b", "a", "B", "c"])))).first()[0] == ["A", "b", "c"]


def test_match_predicates(spark):
    text = F.col("t")
    df = spark.createDataFrame([("every river bends",), ("rivers flow",), ("other words",)], "t string")
    got = df.select(retrieval.has_prefix(text, "rive"), retrieval.has_stem(text, "river"), retrieval.has_stem(text, "river bends"), retrieval.all_prefixes(text, ["every bends"]), retrieval.adjacent(text, ["ever", "riv"])).collect()
    assert [tuple(r) for r in got] == [(True, True, True, True, True), (True, True, False, False, False), (False,) * 5]
    assert retrieval.chains("a b c".split()) == [["a", "b", "c"]]
    assert [len(c) for c in retrieval.chains([str(i) for i in range(12)])] == [6, 6, 4]


def test_trigram_join_loses_no_pair(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abc", k=5)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(words)), "k long, t string")
    grams = [{f"  {w} "[i : i + 3] for i in range(len(w) + 1)} for w in words]
    want = {(i, j) for i, j in itertools.product(range(40), repeat=2) if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.3}
    got = retrieval.trigram_best(df, df, "k", "t", "k", "t").collect()
    assert {(r["l"], r["r"]) for r in got} == want and len(got) == len(want)


def test_scores(spark):
    t = F.col("t")
    df = spark.createDataFrame([("alpha beta gamma delta",)], "t string")
    one = lambda c: df.select(c).first()[0]
    assert one(ranking.hit_score(t, ["alpha", "zeta"])) == 0.5
    assert one(ranking.proximity(t, ["alpha", "delta"])) == pytest.approx(1 / np.log(6))
    assert one(ranking.exact_rank(t, ["alpha beta gamma", "x y z"])) == 1.5
    assert one(ranking.exact_density(t, ["alpha beta gamma"])) == pytest.approx(16 / 22)
    assert one(ranking.score(t, F.lit(0.1), ["alpha"], [], [], ["alpha", "beta"])) == pytest.approx(0.1 + 0.22 + 0.38 * 0.55 - 0.3)
    assert one(ranking.title_bonus(F.array(F.lit("Mahacandimasutta"), F.lit("x")), ["candima"], ("sutta",))) == 1.5
    assert one(ranking.bonus(F.lit("mul"), F.lit(1.5), F.lit(0.5))) == pytest.approx(0.28 + 1.25 * 1.5 + 0.6)


def test_dedup_collapse_diversify(spark):
    df = spark.createDataFrame([("h", False, "att", 0.9, 1), ("h", False, "mul", 0.2, 2), ("h", True, "nrf", 0.1, 3), ("g", False, "mul", 0.5, 4), ("g", False, "mul", 0.5, 5)], "h string, tr boolean, corpus string, score double, id long")
    assert sorted(r["id"] for r in ranking.dedup_by_hash(df, "h", F.col("tr"), F.col("corpus"), "score", "id").collect()) == [3, 4]
    near = spark.createDataFrame([(1, "s", 10), (2, "s", 12), (3, "s", 13), (4, "t", 11), (5, None, 11)], "rank long, s string, at long")
    assert sorted(r["rank"] for r in ranking.collapse_adjacent(near, "s", "at", "rank").collect()) == [1, 3, 4, 5]
    alike = spark.createDataFrame([(1, ["a", "b"], "x"), (2, ["a", "b"], "y"), (3, ["c"], "x")], "rank long, w array<string>, f string")
    assert [r["rank"] for r in ranking.diversify(alike, "rank", "w", "f").orderBy("position").collect()] == [1, 3, 2]


def test_ladder_and_paging(spark):
    assert ranking.query_ladder("seek the lamp, lamp oil") == ["seek lamp, lamp oil", "lamp seek oil", "lamp seek", "lamp"]
    assert ranking.query_ladder("lamp") == []
    df = spark.range(30)
    assert [r["id"] for r in ranking.page(df, [F.desc("id")], 2, 5).orderBy("rank").collect()] == [24, 23, 22, 21, 20]
    events = df.select(F.lit(1).alias("ts"), "id")
    assert [r["id"] for r in ranking.keyset_page(events, "ts", "id", 2, (1, 10)).collect()] == [9, 8, 7]
    assert ranking.first_step_with_rows(["a", "b"], lambda s: df.filter("id < 0") if s == "a" else df)[0] == "b"


def current(spark):
    return spark.createDataFrame([(1, "a", "manual"), (2, "b", "heuristic"), (3, "c", "heuristic"), (4, "d", None)], "id long, text string, method string")


def test_precedence_upsert_is_idempotent(spark):
    new = spark.createDataFrame([(1, "x", "heuristic"), (2, "y", "strict_unique"), (3, "c", "heuristic"), (5, "e", None), (5, "f", "manual")], "id long, text string, method string")
    once = upsert.precedence_upsert(current(spark), new, ["id"], ["text"])
    assert {r["id"]: (r["text"], r["action"]) for r in once.collect()} == {1: ("a", "keep"), 2: ("y", "update"), 3: ("c", "keep"), 4: ("d", "keep"), 5: ("f", "insert")}
    again = upsert.precedence_upsert(once.drop("action"), new, ["id"], ["text"])
    assert {r["action"] for r in again.collect()} == {"keep"}


def test_plan_guard_history_and_children(spark):
    cur = current(spark)
    items = spark.createDataFrame([(1, "a", "manual"), (2, "z", "heuristic"), (9, "n", "manual")], "id long, text string, method string")
    plan = upsert.plan(cur, items, ["id"], ["text", "method"], F.lit(False))
    assert {r["id"]: r["action"] for r in plan.collect()} == {1: "unchanged", 2: "update", 9: "insert"}
    nxt = upsert.apply_plan(cur, plan, ["id"])
    assert {r["id"]: r["text"] for r in nxt.collect()} == {1: "a", 2: "z", 3: "c", 4: "d", 9: "n"}
    assert {r["action"] for r in upsert.plan(nxt, items, ["id"], ["text", "method"], F.lit(False)).collect()} == {"unchanged"}
    with pytest.raises(ValueError):
        upsert.apply_plan(cur, upsert.plan(cur, items, ["id"], ["text"], F.col("id") == 9), ["id"])
    stay, gone = upsert.archive_split(cur, items.select("id"), "id", "b")
    assert stay.count() == 2 and {r["replaced_by_batch"] for r in gone.collect()} == {"b"}
    assert {r["id"]: r["action"] for r in upsert.sync_children(cur, items, "id", ["text"]).collect()} == {1: "keep", 2: "update", 3: "delete", 4: "delete", 9: "insert"}


def test_replacement_swap_version(spark):
    old = spark.createDataFrame([("g", 0, 4, "heuristic"), ("g", 5, 9, "heuristic"), ("m", 0, 9, "manual")], "g string, start long, end long, method string")
    new = spark.createDataFrame([("g", 0, 6, "x"), ("g", 7, 9, "x"), ("m", 0, 9, "x")], "g string, start long, end long, method string")
    assert {r["g"]: r["replaceable"] for r in upsert.replaceable(old, new, "g").collect()} == {"g": True, "m": False}
    edits = spark.createDataFrame([(1, "a", "A"), (2, "no", "B")], "id long, old string, new string")
    assert {r["id"]: r["text"] for r in upsert.compare_and_swap(current(spark), edits, "id", "text").collect()} == {1: "A", 2: "b", 3: "c", 4: "d"}
    moves = spark.createDataFrame([(1, "b"), (2, "q")], "id long, to string")
    assert {r["id"]: r["action"] for r in upsert.repoint(current(spark), moves, "id", "text").collect()} == {1: "move", 2: "move"}
    notice = spark.createDataFrame([("hi", 3)], "text string, version int")
    assert upsert.bump_version(notice, spark.createDataFrame([("hi",)], "text string"), ["text"]).first()["version"] == 3
    assert upsert.bump_version(notice, spark.createDataFrame([("new",)], "text string"), ["text"]).first()["version"] == 4


@pytest.mark.parametrize("repeat", [False, True])
def test_best_chain_against_all_chains(repeat):
    rng = random.Random(7)
    for _ in range(40):
        pairs = sorted({(rng.randrange(5), rng.randrange(6)) for _ in range(rng.randrange(1, 9))})
        weight = [rng.randrange(1, 9) for _ in pairs]
        best = 0
        for n in range(1, len(pairs) + 1):
            for c in itertools.combinations(range(len(pairs)), n):
                ok = all(pairs[a][0] < pairs[b][0] and (pairs[a][1] <= pairs[b][1] if repeat else pairs[a][1] < pairs[b][1]) for a, b in itertools.pairwise(c))
                best = max(best, sum(weight[i] for i in c)) if ok else best
        got = align.best_chain(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), np.array(weight, float), repeat)
        assert sum(weight[i] for i in got) == best


def test_alignment_frames(spark):
    df = spark.createDataFrame([("w", 0, 5, 1.0), ("w", 1, 2, 1.0), ("w", 2, 3, 1.0), ("v", 0, 0, 1.0)], "work string, item long, at long, weight double")
    assert {(r["work"], r["item"]) for r in align.align_monotone(df, "work").collect()} == {("w", 1), ("w", 2), ("v", 0)}
    assert align.longest_nondecreasing(df.drop("weight"), "work").count() == 3
    scored = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.85), (2, 1, 0.7), (2, 2, 0.2), (3, 1, 0.4)], "l long, r long, score double")
    assert rows(align.strict_best(scored, "l").select("l", "r")) == [(2, 1)]
    matches = spark.createDataFrame([("w", 0, 7, 0.9, "a"), ("w", 1, 7, 0.6, "b"), ("w", 2, 8, 0.7, "c")], "work string, item long, at long, score double, text string")
    assert rows(align.merge_matches(matches, "work").select("at", "score", "text")) == [(7, 0.6, "a\nb"), (8, 0.7, "c")]


def test_audits(spark):
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate([10, 10, 10, 10, 20])], "g string, at long, v double")
    assert rows(audit.group_outliers(df, "g", "v").select("at", "ratio")) == [(4, 2.0)]
    assert rows(audit.interior_median(df, "g", "at", F.col("v"), 3).select("n", "median")) == [(3, 10.0)]
    hits = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2)], "i string, t long")
    assert rows(audit.vote(hits, "i", "t").select("i", "t", "hits")) == [("a", 1, 2)]
    assert audit.reconcile(df, df, "g").count() == 0
    text = spark.createDataFrame([("so me some",), ("so me",)], "t string")
    assert rows(audit.joined_pairs(text, F.col("t"))) == [("so", "me", 2, 1)]


def test_providers(spark):
    wanted = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k2", "b")], "k string, t string")
    cache = spark.createDataFrame([("k1", "cached")], "k string, payload string")
    out, fresh = providers.read_through(wanted, cache, ["k"], "t", lambda texts: [x.upper() for x in texts])
    assert rows(out.select("k", "payload")) == [("k1", "cached"), ("k2", "B"), ("k2", "B")] and rows(fresh) == [("k2", "B")]
    broken = providers.call_in_batches(wanted, "t", lambda texts: [])
    assert {r["payload"] for r in broken.collect()} == {None}
    got = spark.createDataFrame([('Sure: {"a": 1}',)], "p string").select(providers.tolerant_json(F.col("p"), "a int").alias("j")).first()["j"]
    assert got["a"] == 1


def test_self_pairs_are_dealt_to_cells(spark, tmp_path):
    rows = [(i, None if i % 3 else 1, "x" if i % 2 else None) for i in range(40)] + [(7, None, "x"), (None, None, "x")]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = catalog.queries()["nullsafe_selfjoin"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= 100
    keyed = [r for r in rows if r[0] is not None]
    assert sorted(map(tuple, got.collect())) == sorted((a[0], b[0]) for a in keyed for b in keyed if a[1:] == b[1:] and a[0] < b[0])


def test_grams_and_anchors(spark):
    text = "ab\U0001F600cdefg" * 40
    got = spark.createDataFrame([(text, "abcd")], "a string, b string").select(S.grams(F.col("a"), 5), S.grams(F.col("b"), 5), S.anchor_similarity(F.col("a"), F.col("a"))).first()
    assert set(got[0]) == {text[i : i + 5] for i in range(len(text) - 4)} and len(got[0]) == len(set(got[0])) and got[1] == [] and got[2] == 1.0
    plan = catalog.queries()["anchor_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(text") >= 2  # whole texts do not meet


def test_words_and_pairs_are_counted_by_one_pass(spark):
    df = spark.createDataFrame([("a b ab",), ("a b",), ("a",), ("",), (None,), ("ab",)], "t string")
    got = audit.joined_pairs(df, F.col("t"))
    assert list(map(tuple, got.collect())) == [("a", "b", 2, 2)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or got._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString().count("ReusedExchange")


def test_spacing_audit_gives_long_pairs_keys_of_their_own(spark):
    from loomtext.operators import pages

    found = pages.spacing_audit(spark.createDataFrame([(i, "bcdf ábcd") for i in range(50)], "k long, t string"), "k", "t")
    assert set(map(tuple, found.drop("k").collect())) == {("bcdf", "ábcd", True, 0)} and found.count() == 50
    assert "ELSE concat( ," in found._jdf.queryExecution().optimizedPlan().toString()  # no key is null for all of them


def test_rows_that_tasks_keep_meet_in_groups(spark):
    from loomtext.operators import search
    from loomtext.plans import search_queries as s

    rows = [(i, i % 5, f"anat {'shed ' * (i % 3)}the x{i}", f"anat {'shed ' * (i % 3)}the x{i}", "mul", str(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, sort_order long, text string, folded string, corpus string, text_hash string").repartition(40)
    analysis = s.ANALYSIS | {"must": [], "stems": []}
    out = search.retrieve(df, analysis, 60)
    got = [(r["branch"], r["doc_id"]) for r in out.collect()]
    want = sorted(rows, key=lambda r: (-(1 + (r[0] % 3 > 0)), r[1], r[0]))[:120]
    assert sorted(i for b, i in got if b == "term") == sorted(r[0] for r in want)
    assert "__g" in out._jdf.queryExecution().optimizedPlan().toString()


def test_outlines_of_asked_sections_alone(spark):
    from loomtext.operators import tree

    rows = [(1, 9, "whole", ["d"], 0, 59)] + [(k + 2, 9, f"part {k}", ["d", f"part {k}"], 4 * k, 59 if k == 0 else 4 * k + 3) for k in range(15)]
    s = spark.createDataFrame(rows, "id long, doc_id long, title string, path array<string>, start long, end long")
    all_, some = (sorted(map(tuple, d.collect())) for d in (tree.outlines(s, "doc_id"), tree.outlines(s, "doc_id", s.filter("title = 'whole'"))))
    assert some == [r for r in all_ if r[0] == 1] and len(some) > 1 and len(all_) > len(some)
