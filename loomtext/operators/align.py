"""Order-preserving alignment. Candidate pairs come from joins; the dynamic programme is the one sequential step and
runs per work, whose size is a book's."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_chain(item: np.ndarray, at: np.ndarray, weight: np.ndarray, repeat: bool) -> np.ndarray:
    """Indices of the heaviest chain with items increasing and positions increasing (repeat: not decreasing); ties to
    the chain found first. Prefix maxima in a binary indexed tree, O(n log n)."""
    order = np.lexsort((at, item))
    rank = np.unique(at, return_inverse=True)[1] + 1
    size = int(rank.max(initial=0))
    best, who = np.zeros(size + 1), np.full(size + 1, -1)
    total, before = np.zeros(len(item)), np.full(len(item), -1)
    start = 0
    while start < len(order):
        stop = start
        while stop < len(order) and item[order[stop]] == item[order[start]]:
            stop += 1
        for i in order[start:stop]:
            r = int(rank[i]) - (0 if repeat else 1)
            value, tag = 0.0, -1
            while r > 0:
                if best[r] > value:
                    value, tag = best[r], who[r]
                r -= r & -r
            total[i], before[i] = value + weight[i], tag
        for i in order[start:stop]:
            r = int(rank[i])
            while r <= size:
                if total[i] > best[r]:
                    best[r], who[r] = total[i], i
                r += r & -r
        start = stop
    out, i = [], -1
    if len(order):
        top = order[int(np.argmax(total[order]))]
        i = int(top) if total[top] > 0 else -1
    while i >= 0:
        out.append(i)
        i = int(before[i])
    return np.array(out[::-1], np.int64)


def align_monotone(pairs: DataFrame, work: str, repeat: bool = True) -> DataFrame:
    """The rows (work, item, at, weight) of each work's heaviest order-preserving matching."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[best_chain(pdf["item"].to_numpy(), pdf["at"].to_numpy(), pdf["weight"].to_numpy(float), repeat)]

    return pairs.groupBy(work).applyInPandas(run, pairs.schema)


def longest_nondecreasing(pairs: DataFrame, work: str) -> DataFrame:
    """The rows (work, item, at) of a longest subsequence by item whose positions do not decrease."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "at"])
        tails, at, before = [], [], []
        for i, x in enumerate(pdf["at"]):
            j = bisect_right(tails, x)
            before.append(at[j - 1] if j else -1)
            tails[j : j + 1], at[j : j + 1] = [x], [i]
        out, i = [], at[-1] if at else -1
        while i >= 0:
            out.append(i)
            i = before[i]
        return pdf.iloc[out[::-1]]

    return pairs.groupBy(work).applyInPandas(run, pairs.schema)


def strict_best(scored: DataFrame, left: str, least: float = 0.5, margin: float = 0.1) -> DataFrame:
    """Each left's best match if it is good and clearly ahead of the second."""
    w = Window.partitionBy(left).orderBy(F.desc("score"), "r")
    ranked = scored.withColumn("__n", F.row_number().over(w)).withColumn("__next", F.lead("score").over(w))
    return ranked.filter((F.col("__n") == 1) & (F.col("score") >= least) & (F.col("score") - F.coalesce("__next", F.lit(0.0)) >= margin)).drop("__n", "__next")


def merge_matches(matches: DataFrame, work: str) -> DataFrame:
    """Neighbouring items matched to one position: joined text, least score."""
    w = Window.partitionBy(work).orderBy("item")
    runs = matches.withColumn("__new", (~F.col("at").eqNullSafe(F.lag("at").over(w))).cast("int")).withColumn("__run", F.sum("__new").over(w))
    parts = F.array_sort(F.collect_list(F.struct("item", "text")))
    return runs.groupBy(work, "__run").agg(F.first("at").alias("at"), F.min("score").alias("score"), parts.alias("p")).select(work, "at", "score", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def ordinal_zip(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """Rows joined by their ordinal, for keys where both sides have as many."""
    number = lambda df, order: df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).withColumn("__all", F.count("*").over(Window.partitionBy(key)))
    return number(left, left_order).join(number(right, right_order), [key, "__n", "__all"]).drop("__all").withColumnRenamed("__n", "ordinal")
