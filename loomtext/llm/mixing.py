"""Mixing to target weights by hierarchical budgeting, with DataFrame functions only.

Leaves are (domain, lang, source). The token budget goes down the tree: a node's children share its budget by weight,
none gets more than it can give (its tokens times max_epochs), and what one cannot take goes to its siblings; only what
all children together cannot take stays with the node's own siblings. With children sorted by capacity / weight the
exhausted ones are a prefix, so that running sums settle a level without iteration, in whole numbers.

A leaf's budget is a number of whole epochs and a token prefix of one more, whose order is seeded by leaf epoch. The
prefix ends at a cut-off key, found from sums over 4096 key buckets and then within one bucket, so that no task holds
a leaf. Documents are chosen by comparing their key to the cut-off. A tree of few leaves is settled by single tasks, a
larger one by a shuffle's tasks at every step.

Defined cases: a null domain, lang or source is the empty name; a null text costs one token; a document costs its words
plus one; rows that agree in id and text have one key and are taken together; an empty table or a zero budget gives
no rows; a very long text is counted whole; other columns stay unless they have an output's name (domain, tokens, epoch), which then is the output.
Weights are whole numbers up to 10,000; a name without a weight has 1, a weight of 0 or less excludes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

TREE = ("domain", "lang", "source")
#: The domain of a source goes by the last digit of its name.
DOMAINS = {"web": "01234", "books": "567", "news": "89"}
WEIGHTS = {"domain": {"web": 5, "books": 3, "news": 2, "other": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 2}}


def domain_of(source: Column) -> Column:
    last = F.substring(source, -1, 1)
    found = F.lit("other")
    for name, digits in DOMAINS.items():
        found = F.when(last.isin(*digits), name).otherwise(found)
    return found


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def order_key(seed: int, epoch: Column, doc_id: Column, digest: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), text(epoch), text(doc_id), digest).cast("binary"))


def share(nodes: DataFrame, parents: list[str], budget: str, held: Callable[[DataFrame, str], DataFrame] = staged) -> DataFrame:
    """nodes (parents..., w, c, budget) with what each gets, as `got`. held: writes a table and reads it back.

    A node is full if filling all siblings to its level c / w costs no more than the budget, which holds up to some level.
    Siblings are summed in 4096 steps of 2 to the 1/64 of c / w, and only those of the one step in which the level lies are
    sorted, so that no task holds all children of a node."""
    whole = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")  # noqa: E731  products have 38 digits
    cost = lambda below, c, beyond, w: whole(below) * whole(w) + whole(c) * whole(beyond) <= whole(budget_) * whole(w)
    budget_, ratio = "_budget", F.col("c") / F.col("w")
    sums = (F.sum("c").alias("_c"), F.sum("w").alias("_w"), F.max(F.struct(ratio.alias("r"), "c", "w")).alias("_m"), F.first(budget).alias("_budget"))
    rows = nodes.withColumns({"_k": F.when(F.col("c") > 0, F.floor(F.log2(ratio) * 64)).otherwise(-(1 << 20))})
    by = parents
    in_order = lambda key: Window.partitionBy(*by).orderBy(key)
    upto = lambda key: F.sum("_c").over(in_order(key).rowsBetween(Window.unboundedPreceding, 0))
    beyond = lambda key: F.coalesce(F.sum("_w").over(in_order(key).rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    steps = rows.groupBy(*by, "_k").agg(*sums).withColumns({"_upto": upto("_k"), "_beyond": beyond("_k")})
    edge = steps.filter(~cost("_upto", "_m.c", "_beyond", "_m.w")).groupBy(*by).agg(F.min_by(F.struct("_k", (F.col("_upto") - F.col("_c")).alias("below"), "_beyond"), "_k").alias("_e"))
    marked = rows.join(edge, by, "left")
    within = marked.filter(F.col("_k") == F.col("_e._k")).groupBy(*by, ratio.alias("_r"), "_e").agg(*sums)
    within = within.withColumns({"_upto": upto("_r") + F.col("_e.below"), "_over": beyond("_r") + F.col("_e._beyond")})
    level = within.filter(cost("_upto", "_m.c", "_over", "_m.w")).groupBy(*by).agg(F.max("_r").alias("_level"))
    full = F.col("_e").isNull() | (F.col("_k") < F.col("_e._k")) | F.coalesce((F.col("_k") == F.col("_e._k")) & (ratio <= F.col("_level")), F.lit(False))
    marked = held(marked.join(level, by, "left").withColumn("_full", full), "levels")  # a row a node; its plan would grow from level to level
    spent = marked.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_full"), F.col("c"))), F.lit(0)).alias("_s"), F.sum(F.when(~F.col("_full"), F.col("w"))).alias("_rest"))
    rest = F.expr(f"(cast({budget} - _s as decimal(19,0)) * cast(w as decimal(19,0))) div _rest")
    return marked.join(spent, by).withColumn("got", F.when(F.col("_full"), F.col("c")).otherwise(rest)).drop("_k", "_e", "_level", "_full", "_s", "_rest")


def weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    return reduce(lambda other, kv: F.when(F.col(level) == kv[0], F.lit(int(kv[1]))).otherwise(other), weights.get(level, {}).items(), F.lit(1)).cast("long")


def leaf_plan(slim: DataFrame, weights: dict, percent: int, max_epochs: int, seed: int, few: int = 1 << 16) -> DataFrame:
    """Of each leaf: whole epochs and the cut-off key of the next. slim: (domain, lang, source, doc_id, tokens, digest). Up
    to `few` leaves are in one partition, so that the tree's steps need no shuffle."""
    leaves = slim.groupBy(*TREE).agg(F.sum("tokens").alias("tokens"))
    for level in TREE:
        leaves = leaves.withColumn(f"w_{level}", weight(level, weights)).filter(F.col(f"w_{level}") > 0)
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    leaves = staged(leaves.withColumn("root", F.lit(0)), "leaves")
    total, number = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    held = (lambda df, name: staged(df, name).coalesce(1)) if number <= few else staged
    plan = (leaves.coalesce(1) if number <= few else leaves).withColumn("budget", F.lit(total * int(percent) // 100).cast("long"))
    for depth, level in enumerate(TREE):
        path = ["root", *TREE[: depth + 1]]
        nodes = plan.groupBy(*path).agg(F.first("budget").alias("budget"), F.first(f"w_{level}").alias("w"), F.sum("cap").alias("c"))
        nodes = held(nodes, "nodes")
        plan = held(plan.drop("budget").join(share(nodes, path[:-1], "budget", held).select(*path, F.col("got").alias("budget")), path), "budgets")
    plan = staged(plan.select(*TREE, F.expr("int(budget div tokens)").alias("whole"), F.expr("budget % tokens").alias("rest")), "mixleaves")
    keyed = slim.join(plan, list(TREE)).withColumn("key", order_key(seed, F.col("whole"), F.col("doc_id"), F.col("digest"))).withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.filter("rest > 0").groupBy(*TREE, "rest", "bucket").agg(F.sum("tokens").alias("t"))
    in_leaf = Window.partitionBy(*TREE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("done", F.coalesce(F.sum("t").over(in_leaf), F.lit(0))).filter("done < rest and done + t >= rest")
    edge = staged(edge.select(*TREE, "bucket", "done"), "mixedges")
    by_key = Window.partitionBy(*TREE).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = keyed.join(edge, [*TREE, "bucket"]).groupBy(*TREE, "rest", "done", "key").agg(F.sum("tokens").alias("tokens"))
    last = last.withColumn("upto", F.col("done") + F.sum("tokens").over(by_key) - F.col("tokens")).filter("upto < rest").groupBy(*TREE).agg(F.max("key").alias("cut"))
    return staged(plan.join(last, list(TREE), "left").select(*TREE, "whole", F.coalesce("cut", F.lit("")).alias("cut")), "mixplan")


def mix(docs: DataFrame, domain: Column | None = None, weights: dict[str, dict[str, int]] | None = None, percent: int = 100, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """docs chosen for a budget of percent of their tokens, a row for each epoch that has the document, with domain,
    tokens and epoch."""
    weights = WEIGHTS if weights is None else weights
    name = lambda c: F.coalesce(c, F.lit(""))
    domain = domain_of(F.col("source")) if domain is None else domain
    leaf = {"__domain": name(domain), "__lang": name(F.col("lang")), "__source": name(F.col("source"))}
    rows = docs.drop("domain", "tokens", "epoch").withColumns(leaf)
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    slim = staged(rows.select(*(F.col(f"__{c}").alias(c) for c in TREE), "doc_id", tokens_of(F.col("text")).alias("tokens"), digest.alias("digest")), "mixslim")
    plan = leaf_plan(slim, weights, percent, max_epochs, seed).select(*(F.col(c).alias(f"__{c}") for c in TREE), F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    # The plan has a row for each leaf; Spark sees its size and broadcasts it only under its own threshold.
    chosen = rows.join(plan, [f"__{c}" for c in TREE])
    taken = F.col("__whole") + (order_key(seed, F.col("__whole"), F.col("doc_id"), digest) <= F.col("__cut")).cast("int")
    chosen = chosen.withColumn("__taken", taken).filter("__taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__taken") - 1)))
    return chosen.withColumns({"domain": F.col("__domain"), "tokens": tokens_of(F.col("text"))}).drop(*leaf, "__whole", "__cut", "__taken")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def _case(level: str) -> str:
    return f"CASE {' '.join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS[level].items())} ELSE 1 END"


def _level(depth: int, budget: str) -> str:
    path, up = ", ".join(TREE[: depth + 1]), ", ".join(TREE[:depth])
    by = f"PARTITION BY {up}" if up else ""
    name = TREE[depth]
    join = "l JOIN g" + str(depth - 1) + f" b USING ({up})" if depth else "l"
    return f"""n{depth} AS (
  SELECT {path}, CAST({budget} AS HUGEINT) AS budget, CAST({_case(name)} AS HUGEINT) AS w, CAST(sum(cap) AS HUGEINT) AS c FROM {join} GROUP BY {path}, {budget if depth else "1"}
), f{depth} AS (
  SELECT *, coalesce(sum(c) OVER (w{depth} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * w
    + c * sum(w) OVER (w{depth} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= budget * w AS satisfied
  FROM n{depth} WINDOW w{depth} AS ({by} ORDER BY c::DOUBLE / w::DOUBLE, {name})
), g{depth} AS (
  SELECT {path}, CAST(CASE WHEN satisfied THEN c ELSE ((budget - coalesce(sum(c) FILTER (satisfied) OVER ({by}), 0)) * w)
    // sum(w) FILTER (NOT satisfied) OVER ({by}) END AS BIGINT) AS got FROM f{depth}
)"""


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, lang AS lang0, source AS source0,
    CASE {' '.join(f"WHEN right(source, 1) IN ({', '.join(f"'{x}'" for x in v)}) THEN '{k}'" for k, v in DOMAINS.items())} ELSE 'other' END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS tokens, md5(coalesce(text, '')) AS digest
  FROM documents
), l AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(2 * sum(tokens) AS BIGINT) AS cap FROM d GROUP BY ALL
), {_level(0, '(SELECT sum(tokens) FROM l)')}, {_level(1, 'b.got')}, {_level(2, 'b.got')}, p AS (
  SELECT domain, lang, source, got // tokens AS whole, got % tokens AS rest FROM l JOIN g2 USING (domain, lang, source)
), k AS (
  SELECT d.*, whole, rest, md5('7|' || whole || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || digest) AS key FROM d JOIN p USING (domain, lang, source)
), s AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING)
    - sum(tokens) OVER (PARTITION BY domain, lang, source, key) AS upto FROM k
), t AS (
  SELECT *, CAST(whole + CASE WHEN upto < rest THEN 1 ELSE 0 END AS BIGINT) AS taken FROM s
)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, tokens, CAST(unnest(range(taken)) AS INTEGER) AS epoch FROM t WHERE taken > 0
"""
