"""Coverage, quality and activity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_values(rows: DataFrame, value: str, n: int = 10) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(n)


def coverage(whole: DataFrame, parts: DataFrame, key: str, group: list[str]) -> DataFrame:
    """Per group, rows, rows with a part, and the percentage, where there is one."""
    have = parts.select(key).distinct().withColumn("__h", F.lit(1))
    out = whole.join(have, key, "left").groupBy(*group).agg(F.count("*").alias("n"), F.count("__h").alias("covered"))
    return out.filter("covered > 0").withColumn("percent", F.round(100.0 * F.col("covered") / F.col("n"), 2))


def interior_median(rows: DataFrame, group: str, order: str, value: Column, least: int = 20, within: tuple[str, ...] = ()) -> DataFrame:
    """The median of rows whose neighbours in the group are both the next positions, in groups with enough of them.
    within: what neighbours share besides, which keeps a large group from one task."""
    w = Window.partitionBy(group, *within).orderBy(order)
    inner = rows.withColumn("__v", value).filter("__v is not null").withColumn("__in", (F.lag(order).over(w) == F.col(order) - 1) & (F.lead(order).over(w) == F.col(order) + 1))
    return inner.filter("__in").groupBy(group).agg(F.count("*").alias("n"), F.percentile("__v", F.lit(0.5)).alias("median")).filter(F.col("n") >= least)


def group_outliers(rows: DataFrame, group: str, value: str, low: float = 0.75, high: float = 1.25, least: int = 4) -> DataFrame:
    """Rows out of proportion to their group's median, by one aggregation and a join, in groups with enough rows."""
    middle = rows.groupBy(group).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.count(value).alias("n")).filter((F.col("n") >= least) & (F.col("median") > 0))
    out = rows.join(middle, group).withColumn("ratio", F.col(value) / F.col("median"))
    return out.filter((F.col("ratio") < low) | (F.col("ratio") > high))


def method_summary(rows: DataFrame, method: str, fullness: str, control: str, weak_below: float = 0.6) -> DataFrame:
    """(method, n, median, p25, weak): of each method's fullness; weak: how many fall below a share of the control method's
    median, 0 without one. p25 is the value at a quarter of the sorted ones."""
    middle = rows.filter(F.col(method) == control).agg(F.percentile(fullness, F.lit(0.5)).alias("__m"))
    with_m = rows.join(middle)  # one row
    return with_m.groupBy(method).agg(
        F.count("*").alias("n"), F.percentile(fullness, F.lit(0.5)).alias("median"), F.element_at(F.array_sort(F.collect_list(fullness)), (F.floor(F.count("*") / 4) + 1).cast("int")).alias("p25"),
        F.count_if(F.col(fullness) < F.col("__m") * weak_below).alias("weak"))


def baseline_by_group(rows: DataFrame, group: str, hits: Column, total: Column) -> DataFrame:
    """(group, n, percent): the mean share of a group's rows, in percent."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(100 * hits / F.greatest(total, F.lit(1))), 4).alias("percent"))


def unit_report(rows: DataFrame, corpus: str, file: str, passages: Column, exact: Column, top: int = 50) -> tuple[DataFrame, DataFrame]:
    """(by corpus and in all, the `top` files with most passages that land on no unit)."""
    n = F.sum(passages).alias("passages")
    by = rows.rollup(corpus).agg(F.count("*").alias("sections"), n, F.count_if(exact).alias("units"), F.coalesce(F.sum(F.when(~exact, passages)), F.lit(0)).alias("missed"))
    files = rows.filter(~exact).groupBy(file).agg(n).orderBy(F.desc("passages"), file).limit(top)
    return by, files


def suffix_profile(rows: DataFrame, group: str, title: Column, tails: list[str], top: int = 4) -> DataFrame:
    """(group, n, with_tail, tails): how many titles of a group end in one of the tails, and its `top` last words by number."""
    ended = title.rlike(f"(?:{'|'.join(tails)})$")
    word = F.element_at(F.split(title, " "), -1)
    counts = rows.withColumns({"__w": word, "__e": ended}).groupBy(group, "__w").agg(F.count("*").alias("c"), F.count_if("__e").alias("e"))
    ranked = counts.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("c"), "__w")))
    best = F.array_sort(F.collect_list(F.when(F.col("__k") <= top, F.struct("__k", F.concat_ws(":", "__w", F.col("c").cast("string")).alias("t")))))
    return ranked.groupBy(group).agg(F.sum("c").alias("n"), F.sum("e").alias("with_tail"), F.array_join(F.transform(best, lambda x: x["t"]), " ").alias("tails"))


def level_profile(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Count, median and largest span, and how many ranges overlap the one before."""
    w = Window.partitionBy(group).orderBy(start, end)
    r = rows.withColumn("__span", F.col(end) - F.col(start) + 1).withColumn("__over", F.coalesce(F.lag(end).over(w) >= F.col(start), F.lit(False)))
    return r.groupBy(group).agg(F.count("*").alias("n"), F.percentile("__span", F.lit(0.5)).alias("median_span"), F.max("__span").alias("max_span"), F.count_if("__over").alias("overlaps"))


def vocabulary(rows: DataFrame, text: Column, least: int = 5, chars: int = 2) -> DataFrame:
    """Words of at least `chars` characters that occur at least `least` times."""
    return rows.select(F.explode(F.split(text, " ")).alias("word")).filter(F.length("word") >= chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def joined_pairs(rows: DataFrame, text: Column, least: int = 2) -> DataFrame:
    """Adjacent words whose concatenation is itself a word, with both counts. A text's last word is paired with a space, so
    that one pass and one shuffle of pairs count the words too: no word has a space, and such pairs meet none."""
    tokens = rows.select(F.explode(F.array(F.split(text, " "))).alias("w"))
    each = tokens.select(F.explode(F.arrays_zip("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("next"))).alias("p"))
    per = each.select(F.coalesce(F.col("p")["w"], F.lit("")).alias("a"), F.coalesce(F.col("p")["next"], F.lit(" ")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("pairs"))
    whole = per.groupBy(F.col("a").alias("word")).agg(F.sum("pairs").alias("n"))
    return per.filter(F.col("pairs") >= least).join(whole, F.concat("a", "b") == F.col("word")).select("a", "b", "pairs", "n")


def character_histogram(rows: DataFrame, text: Column, hazard: str = r"[^\x20-\x7E\n]") -> DataFrame:
    found = rows.select(F.explode(F.regexp_extract_all(text, F.lit(f"({hazard})"), F.lit(1))).alias("char"))
    return found.groupBy("char").agg(F.count("*").alias("n"))


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Row counts by key on both sides, where they differ."""
    x, y = (d.groupBy(key).agg(F.count("*").alias(n)) for d, n in ((a, "left_n"), (b, "right_n")))
    both = x.join(y, key, "full").select(key, F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))
    return both.filter("left_n <> right_n")


def vote(hits: DataFrame, item: str, target: str, least: int = 2) -> DataFrame:
    """Each item's target with most hits, if it has enough of them and more than any other."""
    n = hits.groupBy(item, target).agg(F.count("*").alias("hits"))
    w = Window.partitionBy(item).orderBy(F.desc("hits"), target)
    return n.withColumn("__n", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("hits").over(w), F.lit(0))).filter((F.col("__n") == 1) & (F.col("hits") >= least) & (F.col("hits") > F.col("second"))).drop("__n")
