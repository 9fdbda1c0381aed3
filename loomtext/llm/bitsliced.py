"""Exact top-k inner products with a bit-sliced index.

Components are whole numbers floor(1024 x). A block of rows keeps, for each dimension, bitmaps of the upper bits of its
component (at most `bits`): the quantised attribute slices. For a query, whose components are quantised as well, the
slices are added with bitmap arithmetic (carry-save adders over whole stacks of bitmaps), which gives the slices of a
score that is the true one but for a remainder with known bounds. Going from the most significant slice downward finds
the k-th best value; all rows that the bounds leave in question are selected by a comparison over the slices and
resolved with exact whole-number products. No row is lost: the bounds hold for every row.

Rows of one length are dealt in blocks of bounded size by hash, and queries in groups; each block meets each group once,
so copies and common vectors do not gather, and a block's slices serve a whole group. Rows and queries with components
too large for products of 64 bits are resolved by whole numbers of any size; no vector is left out for its size.

Defined cases: rows with a null id or vector, or with null or non-finite components, take no part; vectors of different
lengths have products over the shorter's components, as if the longer's others were zero, and an empty vector scores 0;
a score beyond 64 bits is returned as the nearest long and ranked by its true value (up to 38 digits); rows equal in id
and vector count once; ties go to the smaller id; with fewer candidates than k all are returned; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table
from .vectors import block_of, sound

SCALE, NARROW, LONG = 1024, 1 << 24, (1 << 63) - 1
WIDEST = 10**38 - 1


def packed(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (..., words) of booleans (..., rows)."""
    rows = -(-bits.shape[-1] // 64) * 64
    wide = np.zeros((*bits.shape[:-1], rows), bool)
    wide[..., : bits.shape[-1]] = bits
    return np.packbits(wide, axis=-1, bitorder="little").view("<u8")


class Slices:
    """Rows x as bitmaps of the upper bits of each component."""

    def __init__(self, x: np.ndarray, bits: int):
        self.x, self.n = x, len(x)
        width = int(np.abs(x).max(initial=0)).bit_length() + 1
        self.drop = max(0, width - bits)
        top = x >> self.drop
        self.width = width - self.drop
        self.largest = np.abs(top).max(axis=0)
        u = top + (1 << (self.width - 1))
        held = packed(np.stack([(u >> i & 1).astype(bool).T for i in range(self.width)], axis=1))
        self.held = np.stack([held, ~held])  # for positive and for negative factors
        self.all = packed(np.ones(self.n, bool))

    def sums(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices, lowest first, of sum(q * (x >> drop)) plus a constant, and the constant."""
        sign = (q < 0).astype(int)
        size = np.abs(q)
        by_bit = [np.nonzero(size >> j & 1)[0] for j in range(int(size.max(initial=0)).bit_length())]
        out, carried, level = [], [], 0
        while level < len(by_bit) + self.width - 1 or carried:
            stack = [self.held[sign[d], d, level - j] for j, d in enumerate(by_bit) if len(d) and 0 <= level - j < self.width] + carried
            carried = []
            s = np.concatenate(stack) if stack else np.zeros((1, len(self.all)), "<u8")
            while len(s) > 2:
                m = len(s) // 3
                a, b, c = s[:m], s[m : 2 * m], s[2 * m : 3 * m]
                x = a ^ b
                carried.append((a & b) | (x & c))
                s = np.concatenate([x ^ c, s[3 * m :]])
            if len(s) == 2:
                carried.append(s[:1] & s[1:])
                s = s[:1] ^ s[1:]
            out.append(s[0])
            level += 1
        middle = 1 << (self.width - 1)
        return out, int((np.where(q < 0, middle - 1, middle) * size).sum())

    def kth(self, slices: list[np.ndarray], k: int) -> int:
        """The k-th largest value, from the most significant slice downward; 0 if there are fewer rows."""
        if self.n <= k:
            return 0
        value, sure, open_ = 0, 0, self.all
        for s in reversed(slices):
            with_bit = open_ & s
            n = int(np.bitwise_count(with_bit).sum())
            value <<= 1
            if sure + n >= k:
                open_, value = with_bit, value | 1
            else:
                sure, open_ = sure + n, open_ & ~s
        return value

    def at_least(self, slices: list[np.ndarray], value: int) -> np.ndarray:
        """Indices of the rows whose value is `value` or more."""
        if value <= 0:
            return np.arange(self.n)
        if value >> len(slices):
            return np.zeros(0, np.int64)
        more, same = np.zeros_like(self.all), self.all
        for i in reversed(range(len(slices))):
            if value >> i & 1:
                same = same & slices[i]
            else:
                more, same = more | (same & slices[i]), same & ~slices[i]
        return np.nonzero(np.unpackbits((more | same).view(np.uint8), bitorder="little")[: self.n])[0]

    def top(self, q: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best, and of all that tie with the last."""
        drop = max(0, int(np.abs(q).max(initial=0)).bit_length() - bits)
        coarse = np.sign(q) * (np.abs(q) >> drop)
        slices, _ = self.sums(coarse)
        rest = q - (coarse << drop)
        # score = 2^(drops) * sum + remainder, whose range is the sum of these two parts' ranges
        spread = (2 * int((np.abs(rest) * self.largest).sum()) << self.drop) + ((1 << self.drop) - 1) * int(np.abs(q).sum())
        least = self.kth(slices, k) - (spread >> (self.drop + drop)) - 1
        at = self.at_least(slices, least)
        scores = self.x[at] @ q
        if len(at) > k:
            keep = scores >= np.partition(scores, -k)[-k]
            at, scores = at[keep], scores[keep]
        return at, scores


def scaled(x: float) -> int:
    """floor(1024 x), whatever its size."""
    return math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE


def fitted(q: list[int], length: int) -> list[int]:
    return [*q[:length], *[0] * (length - len(q))]


class Block:
    """Rows of one length: the narrow ones as slices, the others as whole numbers of any size."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bits: int):
        with np.errstate(over="ignore"):
            whole = np.floor(vectors * SCALE)
        narrow = (np.abs(whole) < NARROW).all(axis=1) if vectors.shape[1] else np.zeros(len(ids), bool)
        self.length, self.narrow_ids = vectors.shape[1], ids[narrow]
        self.x = whole[narrow].astype(np.int64)
        self.slices = Slices(self.x, bits) if len(self.x) else None
        self.largest = int(np.abs(self.x).max(initial=0))
        self.wide = [(int(i), [scaled(float(c)) for c in v]) for i, v in zip(ids[~narrow], vectors[~narrow])]

    def top(self, q: list[int], k: int, bits: int) -> list[tuple[int, int]]:
        """(score, id) of rows among which the k best are, ties included: of the wide rows, all."""
        q = fitted(q, self.length)
        out = [(sum(a * b for a, b in zip(q, v)), i) for i, v in self.wide]
        if self.slices is not None:
            if self.length * self.largest * max(map(abs, q)) < 1 << 62:
                at, scores = self.slices.top(np.array(q, np.int64), k, bits)
                out += zip(scores.tolist(), self.narrow_ids[at].tolist())
            else:
                scores = self.x.astype(object) @ np.array(q, object)
                out += zip(scores.tolist(), self.narrow_ids.tolist())
        return out


def _search(k: int, row_bits: int, query_bits: int) -> Callable:
    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            block = Block(left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()), row_bits)
            for q, v in zip(right["query"], right["q"]):
                found = block.top([scaled(float(x)) for x in v], k + 1, query_bits)
                for less, i in sorted((-max(-WIDEST, min(WIDEST, s)), i) for s, i in found if i != q)[:k]:
                    near = max(-LONG - 1, min(LONG, -less))
                    out.append((q, i, near, Decimal(-less) if near in (LONG, -LONG - 1) else None))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "far"])

    return search


def top_products(vectors: DataFrame, is_query: Column, k: int = 10, block: int = 32768, group: int = 16384, row_bits: int = 7, query_bits: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows (vec_id, embedding) that is_query selects, against all rows."""
    rows = staged(sound(vectors).withColumn("d", F.size("v")), "sound")
    sizes = {r["d"]: r["count"] for r in rows.groupBy("d").count().collect()}  # a row for each length that vectors have
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = rows.filter(is_query).select(F.col("vec_id").alias("query"), F.col("v").alias("q"))
    groups = max(1, math.ceil(asked.count() / group))
    # blocks of at most `block` rows, and of fewer where a table is small, for all cores to have some
    share = max(1, min(block, math.ceil(sum(sizes.values()) / vectors.sparkSession.sparkContext.defaultParallelism)))
    parts = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(math.ceil(n / share)).alias("blocks")) for d, n in sorted(sizes.items())))
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    own = F.get(F.filter(parts, lambda x: x["d"] == F.col("d")), F.lit(0))["blocks"]
    left = rows.withColumn("b", block_of(F.col("vec_id"), own)).withColumn("g", every(F.lit(groups)))
    right = asked.withColumn("g", block_of(F.col("query"), groups)).select("query", "q", "g", F.inline(parts)).withColumn("b", every(F.col("blocks")))
    found = left.groupBy("d", "b", "g").cogroup(right.groupBy("d", "b", "g")).applyInPandas(_search(k, row_bits, query_bits), "query_id long, vec_id long, score long, far decimal(38,0)")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.when(F.col("score") > 0, F.col("far")).desc_nulls_last(), F.when(F.col("score") < 0, F.col("far")).desc_nulls_first(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP5_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS HUGEINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS HUGEINT), 0) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(greatest(-9223372036854775808, least(9223372036854775807, score)) AS BIGINT) AS score FROM r WHERE rank <= 10
"""
