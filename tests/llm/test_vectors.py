"""Approximate nearest neighbours and bit-sliced top-k."""

import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from loomtext.llm import ann, bitsliced

SCHEMA = "vec_id long, embedding array<float>"


def data(n=400, d=12, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.2, (n, d)).astype(np.float32)
    x[50:120] = x[50]  # copies
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    return rows + [(n, None), (n + 1, [0.0] * d), (n + 2, [float("nan")] * d), (n + 3, [None] * d), (n + 5, [float("inf")] * d), (None, rows[0][1]), rows[3]]


def cosines(rows, step, k, d=12):
    own = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)}
    own = {i: v for i, v in own.items() if v.any()}
    out = {}
    for q in (i for i in own if i % step == 0):
        s = sorted((-(own[q] @ v) / math.sqrt((own[q] @ own[q]) * (v @ v)), i) for i, v in own.items() if i != q)
        out[q] = [(i, -c) for c, i in s]
    return out


def test_multi_sequence_order():
    rng = random.Random(1)
    a, b = np.array([rng.random() for _ in range(7)]), np.array([rng.random() for _ in range(5)])
    held = np.ones((7, 5), np.int64)
    held[2, 3] = 0
    got = ann.traverse(a, b, held, 99)
    assert got == sorted(((i, j) for i in range(7) for j in range(5) if held[i, j]), key=lambda c: a[c[0]] + b[c[1]])
    assert len(ann.traverse(a, b, held, 6)) == 6


def test_exact_when_all_cells_are_visited(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash"))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 25 == 0, 5, visit=1.0, block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = cosines(rows, 25, 5)
    assert set(got) == set(want)
    for q, found in got.items():
        assert np.allclose([s for _, s in found], [s for _, s in want[q][:5]], atol=1e-12)
        least = want[q][4][1] + 1e-9
        assert {i for i, s in found if s > least} == {i for i, s in want[q] if s > least}
    copies = [i for i, _ in got[50]]
    assert copies == [51, 52, 53, 54, 55] and [i for i, _ in got[75]] == [50, 51, 52, 53, 54]


def test_recall(spark):
    rows = [(i, v) for i, v in data(2000, 16, 3) if i is not None and i < 2000]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r["query_id"], set()).add(round(r["score"], 9))
    want = cosines(rows, 20, 5, 16)
    hit = sum(round(s, 9) in got[q] for q in want for _, s in want[q][:5])
    assert hit >= 0.9 * 5 * len(want)


def test_ann_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(empty, F.col("vec_id") % 2 == 0).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0, 2.0])], SCHEMA), F.lit(True)).count() == 0
    two = ann.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 4.0])], SCHEMA), F.col("vec_id") == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in two] == [(0, 1, 1, 1.0)]
    huge = ann.nearest(spark.createDataFrame([(0, [1e300, 0.0]), (1, [1e-300, 0.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).first()
    assert huge["score"] == 1.0


def test_slices_add_and_select_exactly():
    rng = np.random.default_rng(4)
    x = rng.integers(-900, 900, (300, 9))
    x[40:90] = x[40]
    s = bitsliced.Slices(x, 7)
    for _ in range(20):
        q = rng.integers(-900, 900, 9)
        slices, constant = s.sums(q)
        value = sum(((np.unpackbits(b.view(np.uint8), bitorder="little")[:300].astype(np.int64)) << i) for i, b in enumerate(slices)) - constant
        assert (value == (x >> s.drop) @ q).all()
        least = s.kth(slices, 10)
        assert least == np.sort(value + constant)[-10]
        assert set(s.at_least(slices, least)) == set(np.nonzero(value + constant >= least)[0])
        at, scores = s.top(q, 10, 5)
        true = x @ q
        assert set(at) == set(np.nonzero(true >= np.sort(true)[-10])[0]) and (scores == true[at]).all()


def test_top_products_against_brute_force(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit("clash"), "b": F.lit(1), "v": F.lit(2), "d": F.lit(3)})
    own = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in rows if i is not None and v is not None and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v)}
    got = {}
    for r in bitsliced.top_products(df, F.col("vec_id") % 50 == 0, 10, block=128, group=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in (i for i in own if i % 50 == 0):
        s = sorted((-int(own[q] @ v), i) for i, v in own.items() if i != q)[:10]
        assert got[q] == [(i, -x) for x, i in s]


def test_bitsliced_edges(spark):
    assert bitsliced.top_products(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, -1.0]), (2, [0.0, 0.0])], SCHEMA)
    got = bitsliced.top_products(few, F.col("vec_id") == 1).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 0, 0), (2, 2, 0)]


def test_products_of_any_size_and_length(spark):
    rng = random.Random(7)
    rows = [(i, [rng.choice([0.5, -3.25, 3e5, -1e17, 1e-9, 1e200]) for _ in range(rng.choice([0, 1, 3, 3, 4]))]) for i in range(60)] + [(100, [3e5, 1.0]), (200, []), (300, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(Fraction(x) * 1024) for x in v] for i, v in rows if v is not None}
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    got = {}
    for r in bitsliced.top_products(df, F.col("vec_id") % 20 == 0, 5, block=16, group=2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 100, 200}
    for q, found in got.items():
        capped = lambda s: max(-(10**38) + 1, min(10**38 - 1, s))
        want = sorted((-capped(product(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        assert found == [(i, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, i in want]


def test_neighbours_of_other_lengths(spark):
    rows = [(i, v) for i, v in data(60, 6, 2) if i is not None and i < 60] + [(100, [1.0]), (150, [0.5, -0.25]), (151, [0.1] * 9), (152, [])]
    want = {}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    own = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if any(v)]
    for q, v in own:
        if q % 50 == 0:
            want[q] = sorted((-round(cosine(v, w), 9), i) for i, w in own if i != q)[:5]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, visit=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(-round(r["score"], 9))
    assert got == {q: [s for s, _ in x] for q, x in want.items()}
