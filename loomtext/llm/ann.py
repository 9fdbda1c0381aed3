"""Approximate nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut into two halves, each quantised by its own k-means codebook, so that a pair of centroids is a cell.
A query walks the pairs in the order of summed distance with a heap, until the cells visited hold `visit` of all
distinct vectors, and its candidates are then ranked by exact cosine in double precision.

The codebooks are fitted on at most `sample` distinct vectors, taken by hash; every row is indexed. Rows with one vector
form one entry that keeps its k + 1 smallest ids, which is all that k neighbours can need, so copies cost nothing. Entries
are dealt by first centroid in blocks of bounded size and lie there by second centroid; a query goes to each first
centroid it visits, with the second centroids visited there, and is multiplied with the entries of these cells alone.
Codebooks and cell counts, both bounded by `most` centroids a half, are what is broadcast.

Measured recall is in the README; `visit` = 1 is exact.

Defined cases: rows with a null id or vector, a zero (or empty) vector, or null or non-finite components take no part,
neither as query nor as candidate; a vector of another length than most is quantised by as many components as most have
and ranked by its cosine over its own, missing components being zero; rows equal in id and vector count once; ties go to
the smaller id; with fewer candidates than k all are returned; an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table
from .vectors import sound


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a power of two first keeps the squares in range, without rounding."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def fitted(vectors: list[np.ndarray], length: int) -> np.ndarray:
    """As rows of one length, cut or filled up with zeros."""
    if all(len(v) == length for v in vectors):
        return np.stack(vectors) if vectors else np.zeros((0, length))
    out = np.zeros((len(vectors), length))
    for row, v in zip(out, vectors):
        row[: len(v)] = v[:length]
    return out


def units(vectors: list[np.ndarray]) -> list[np.ndarray]:
    """Each of length 1."""
    sizes, out = np.array([len(v) for v in vectors]), [None] * len(vectors)
    for n in np.unique(sizes):
        at = np.nonzero(sizes == n)[0]
        for i, v in zip(at, unit(np.stack([vectors[i] for i in at]))):
            out[i] = v
    return out


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centres = x[np.random.default_rng(0).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = distances(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(held > 0, sums / np.maximum(held, 1), centres)
    return centres


def traverse(a: np.ndarray, b: np.ndarray, held: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Cells by increasing a[i] + b[j] until they hold `need` entries."""
    rows, columns = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb, found, have = a[rows], b[columns], [], 0
    heap, reached = [(sa[0] + sb[0], 0, 0)], [0] * len(rows)  # reached: columns passed in each row
    while heap and have < need:
        _, i, j = heapq.heappop(heap)
        reached[i] = j + 1
        cell = int(rows[i]), int(columns[j])
        if held[cell]:
            found.append(cell)
            have += int(held[cell])
        if j == 0 and i + 1 < len(rows):
            heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
        if j + 1 < len(columns):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
    return found


def entries(vectors: DataFrame, ids: int) -> DataFrame:
    """(v, ids): the smallest ids of each distinct vector, in two steps so that a very common one is no task's load."""
    salted = Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(32))).orderBy("vec_id")
    first = vectors.withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= ids)
    few = first.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= ids)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _rank(k: int) -> Callable:
    def rank(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            e, q = units(list(left["v"])), units(list(right["v"]))
            lengths, cells = np.array([len(v) for v in e]), left["c2"].to_numpy()
            asked: dict[int, list[int]] = {}
            for i, visited in enumerate(right["c2"]):
                for c in visited:
                    asked.setdefault(int(c), []).append(i)
            near = np.full((len(q), len(e)), -np.inf)
            for n in np.unique(lengths):
                own, order = fitted(q, int(n)), np.nonzero(lengths == n)[0]
                order = order[np.argsort(cells[order], kind="stable")]
                rows, starts = np.stack([e[i] for i in order]), np.unique(cells[order], return_index=True)
                for c, a, b in zip(starts[0], starts[1], [*starts[1][1:], len(order)]):  # one cell
                    if who := asked.get(int(c)):
                        near[np.ix_(who, order[a:b])] = own[who] @ rows[a:b].T
            ids, first = left["ids"].to_numpy(), np.array([x[0] for x in left["ids"]])
            for i, (qid, qh) in enumerate(zip(right["qid"], right["qh"])):
                row = near[i]
                least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                at = np.nonzero((row >= least) & (row > -np.inf))[0]
                order = at[np.lexsort((first[at], -row[at]))]
                pairs = sorted((-float(row[j]), int(x)) for j in order[:k] for x in ids[j])[:k]  # an entry's ids come before any worse entry's
                out += [(qid, qh, x, -s) for s, x in pairs]
        return pd.DataFrame(out, columns=["qid", "qh", "vec_id", "score"])

    return rank


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, visit: float = 0.6, sample: int = 20_000, most: int = 160, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows (vec_id, embedding) that is_query selects, against all rows."""
    spark = vectors.sparkSession
    rows = staged(sound(vectors).filter(F.exists("v", lambda x: x != 0)), "vectors")
    index = staged(entries(rows, k + 1), "entries")
    n = index.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    length = index.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()["n"]
    taken = index.filter(F.size("v") == length).orderBy(F.xxhash64("v"), "v").limit(sample)
    fit = unit(np.stack([np.asarray(r["v"]) for r in taken.select("v").collect()]))
    half = (length + 1) // 2
    size = max(2, min(most, max(16, math.isqrt(n))))
    halves = lambda x: (x[:, :half], x[:, half:] if half < length else np.zeros((len(x), 1)))
    books = [kmeans(x, size) for x in halves(fit)]
    coarse = lambda vectors: halves(unit(fitted(list(vectors), length)))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                own = [distances(x, c).argmin(1).astype(np.int32) for x, c in zip(coarse(part["v"]), books)]
                yield part.assign(c1=own[0], c2=own[1])

    placed = staged(index.mapInPandas(place, "v array<double>, ids array<long>, c1 int, c2 int"), "cells")
    held = np.zeros([len(b) for b in books], np.int64)
    for r in placed.groupBy("c1", "c2").count().collect():  # at most most * most rows
        held[r["c1"], r["c2"]] = r["count"]
    asked = rows.filter(is_query)
    queries = staged(asked.groupBy("v").agg(F.min("vec_id").alias("qid")).withColumn("qh", F.xxhash64("v")), "queries")
    number = queries.count()
    groups = max(1, math.ceil(number / block))
    blocks = np.maximum(1, -(-held.sum(1) // block))
    need = max(k + 1, math.ceil(visit * n))

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            if len(part):
                first, second = (distances(x, c) for x, c in zip(coarse(part["v"]), books))
                for v, qid, qh, a, b in zip(part["v"], part["qid"], part["qh"], first, second):
                    by: dict[int, list[int]] = {}
                    for i, j in traverse(a, b, held, need):
                        by.setdefault(i, []).append(j)
                    out += [(v, qid, qh, i, j, c2) for i, c2 in by.items() for j in range(blocks[i])]
            yield pd.DataFrame(out, columns=["v", "qid", "qh", "c1", "b", "c2"])

    per = F.element_at(F.array(*(F.lit(int(x)) for x in blocks)), F.col("c1") + 1)
    # a walk takes milliseconds and a query some hundred bytes: the walks are dealt to all cores whatever the rows' size
    dealt = queries.repartition(max(2 * spark.sparkContext.defaultParallelism, number // 512), "qh")
    right = dealt.mapInPandas(ask, "v array<double>, qid long, qh long, c1 int, b int, c2 array<int>").withColumn("g", F.pmod("qh", F.lit(groups)).cast("int"))
    left = placed.withColumn("b", F.pmod(F.xxhash64("v"), per).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    key = ["c1", "b", "g"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_rank(k + 1), "qid long, qh long, vec_id long, score double")
    best = Window.partitionBy("qid", "qh").orderBy(F.desc("score"), "vec_id")
    lists = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).groupBy("qid", "qh").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("top"))
    named = queries.join(lists, ["qid", "qh"]).select("v", "top")
    mine = asked.join(named, "v").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("top"))
    return mine.select("query_id", F.posexplode("top").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
