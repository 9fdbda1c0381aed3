"""Interval and tree operators over documents of ordered passages.

Ranges are inclusive; an open end is the start. Joins of positions and ranges are equi-joins on (document, bucket of
`width` positions), so that a very long document is no task's load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import path_is_prefix


def buckets(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def closed(ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    return ranges.withColumn(end, F.coalesce(F.col(end), F.col(start)))


def point_in_range(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str = "start", end: str = "end", width: int = 64, how: str = "inner") -> DataFrame:
    """Each point with every range of its document that holds it."""
    r = closed(ranges, start, end).withColumn("__b", buckets(F.col(start), F.col(end), width))
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    return p.join(r, [p[key] == r[key], p["__b"] == r["__b"], p[at].between(r[start], r[end])], how).drop(r[key], r["__b"]).drop("__b")


def shortest_range(points: DataFrame, ranges: DataFrame, key: str, point: str, at: str, range_id: str, start: str = "start", end: str = "end") -> DataFrame:
    """Each point with the shortest range that holds it, ties to the smaller range id."""
    found = point_in_range(points, ranges, key, at, start, end)
    first = Window.partitionBy(key, point).orderBy(F.col(end) - F.col(start), F.col(range_id))
    return found.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def overlaps(a: DataFrame, b: DataFrame, key: str, width: int = 64) -> DataFrame:
    """Pairs (a_id, b_id) of ranges (id, key, start, end) that overlap within a document."""
    x = closed(a).select(key, F.col("id").alias("a_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    y = closed(b).select(key, F.col("id").alias("b_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    x = x.withColumn("__b", buckets(F.col("a_start"), F.col("a_end"), width))
    y = y.withColumn("__b", buckets(F.col("b_start"), F.col("b_end"), width))
    met = x.join(y, [key, "__b"]).filter("a_start <= b_end and a_end >= b_start")
    # a pair shares several buckets; it counts in the first that both have
    return met.filter(F.col("__b") == F.floor(F.greatest("a_start", "b_start") / width)).drop("__b")


def by_passage_or_range(passages: DataFrame, texts: DataFrame, key: str, passage: str, at: str) -> DataFrame:
    """Passages with the texts that name them or whose range holds them: two joins instead of one with OR."""
    direct = passages.join(texts.filter("start is null").drop(key), passage)
    ranged = point_in_range(passages, texts.filter("start is not null").drop(passage), key, at)
    return direct.unionByName(ranged.select(direct.columns)).dropDuplicates([passage, "text_id"])


def smallest_ancestor(sections: DataFrame, key: str, qualifies: Column) -> DataFrame:
    """(id, ancestor): the smallest qualifying section that holds each section, ties to the deepest, then by id."""
    s = closed(sections)
    inner = s.select(key, "id", "start", "end")
    outer = s.filter(qualifies).select(key, F.col("id").alias("ancestor"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.size("path").alias("depth"))
    held = inner.withColumn("__b", F.floor(F.col("start") / 64)).join(outer.withColumn("__b", buckets(F.col("o_start"), F.col("o_end"), 64)), [key, "__b"])
    held = held.filter("o_start <= start and o_end >= end")
    first = Window.partitionBy("id").orderBy(F.col("o_end") - F.col("o_start"), F.desc("depth"), "ancestor")
    found = held.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select("id", "ancestor")
    return inner.select("id").join(found, "id", "left")


def clip_overreach(sections: DataFrame, key: str) -> DataFrame:
    """Sections whose range ends before the first section inside it that is not below it; `clipped` says which."""
    s = closed(sections)
    other = s.select(key, F.col("start").alias("o_start"), F.col("path").alias("o_path"))
    inside = s.select(key, "id", "start", "end", "path").withColumn("__b", buckets(F.col("start"), F.col("end"), 64)).join(other.withColumn("__b", F.floor(F.col("o_start") / 64)), [key, "__b"])
    strange = inside.filter((F.col("o_start") > F.col("start")) & (F.col("o_start") <= F.col("end")) & ~path_is_prefix(F.col("path"), F.col("o_path")))
    cut = strange.groupBy("id").agg(F.min("o_start").alias("__cut"))
    return s.join(cut, "id", "left").withColumn("end", F.coalesce(F.col("__cut") - 1, F.col("end"))).withColumn("clipped", F.col("__cut").isNotNull()).drop("__cut")


def below(sections: DataFrame, key: str, parents: DataFrame | None = None) -> DataFrame:
    """(id, child, c_start, c_end, depth): sections and those below them by path and range. A child looks for each
    beginning of its path, so that a document's sections do not all meet. parents: those sections whose children are asked, all if null."""
    s = closed(sections).select(key, "id", "start", "end", "path")
    up = s if parents is None else closed(parents).select(key, "id", "start", "end", "path")
    heads = F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.slice("path", 1, i)))
    child = s.filter(F.size("path") > 1).select(key, F.col("id").alias("child"), F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.size("path").alias("depth"), heads.alias("path"))
    return up.join(child, [key, "path"]).filter("c_start >= start and c_end <= end").select(key, "id", "start", "end", "child", "c_start", "c_end", "depth")


def outline(sections: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(parent, child): of each section, the sections of the shallowest depth below it that has at least `least`."""
    layer = below(sections, key).withColumn("n", F.count("*").over(Window.partitionBy("id", "depth"))).filter(F.col("n") >= least)
    top = layer.withColumn("least", F.min("depth").over(Window.partitionBy("id"))).filter("depth = least")
    return top.select(F.col("id").alias("parent"), "child", "c_start", "depth")


def close_ranges(starts: DataFrame, key: str, start: str, last: DataFrame) -> DataFrame:
    """starts with `end`: one before the next start, or the document's last position (key, last)."""
    nxt = F.lead(start).over(Window.partitionBy(key).orderBy(start)) - 1
    return starts.join(last, key, "left").withColumn("end", F.coalesce(nxt, F.col("last"))).drop("last")


def islands(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Maximal runs of one value over consecutive positions: (key, value, start, end, n)."""
    w = Window.partitionBy(key).orderBy(at)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.col(at) != F.lag(at).over(w) + 1) | F.lag(at).over(w).isNull()
    runs = rows.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(w))
    return runs.groupBy(key, "__run").agg(F.first(value).alias(value), F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("__run")


def merge_blocks(rows: DataFrame, key: str, at: str, row_id: str, text: str, joins: Column) -> DataFrame:
    """Display blocks: non-blank rows, of which neighbours that both join are one block that keeps their ids."""
    w = Window.partitionBy(key).orderBy(at)
    kept = rows.filter(F.trim(text) != "").withColumn("__j", joins)
    kept = kept.withColumn("__new", (~(F.col("__j") & F.coalesce(F.lag("__j").over(w), F.lit(False)))).cast("int")).withColumn("block", F.sum("__new").over(w))
    parts = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(row_id).alias("id"), F.trim(text).alias("t"))))
    return kept.groupBy(key, "block").agg(parts.alias("p")).select(
        key, "block", F.get("p", F.lit(0))["at"].alias("start"), F.transform("p", lambda x: x["id"]).alias("ids"), F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text")
    )


def numbered_in_group(rows: DataFrame, key: str, at: str, header: Column) -> DataFrame:
    """group_no and number within the group, which each header begins anew."""
    w = Window.partitionBy(key).orderBy(at)
    grouped = rows.withColumn("__h", header.cast("int")).withColumn("group_no", F.sum("__h").over(w))
    inner = Window.partitionBy(key, "group_no").orderBy(at)
    return grouped.withColumn("number", F.sum(1 - F.col("__h")).over(inner)).drop("__h")


def occurrence(rows: DataFrame, same: list[str], at: str) -> DataFrame:
    """occurrence and occurrences of rows that agree in `same`; null-safe."""
    w = Window.partitionBy(*same)
    return rows.withColumn("occurrence", F.row_number().over(w.orderBy(at))).withColumn("occurrences", F.count("*").over(w))


def fill_forward(rows: DataFrame, key: str, at: str, tag: str) -> DataFrame:
    """The last tag that did not go backwards."""
    w = Window.partitionBy(key).orderBy(at)
    before = F.max(tag).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ok = rows.withColumn("__t", F.when(before.isNull() | (F.col(tag) >= before), F.col(tag)))
    return ok.withColumn("filled", F.last("__t", ignorenulls=True).over(w)).drop("__t")


def rotate(rows: DataFrame, key: str, at: str, pivot: Column) -> DataFrame:
    """Position from the pivot on, then from the beginning."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy((F.col(at) < pivot).cast("int"), at)))


def prune_path(path: Column) -> Column:
    """No item twice, whatever its case."""
    step = lambda seen, x: F.when(F.array_contains(F.transform(seen, F.lower), F.lower(x)), seen).otherwise(F.concat(seen, F.array(x)))
    return F.aggregate(path, F.array().cast("array<string>"), step)


def merge_by_source(chosen: DataFrame, group: list[str], total: Column, at: str = "at", text: str = "text") -> DataFrame:
    """Texts joined in order per group, with the positions missing of `total` and the coverage in percent."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(text).alias("t"))))
    out = chosen.groupBy(*group).agg(parts.alias("p"), F.countDistinct(at).alias("present"), F.max(total).alias("total"))
    return out.select(*group, F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"), (F.col("total") - F.col("present")).alias("missing"), F.round(100 * F.col("present") / F.col("total"), 0).cast("int").alias("percent"))
