"""Reading units, outlines and citation paths over section trees. A tree's relation is the path's prefix, not the range
alone; ranges that reach too far are clipped where a strange section begins."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import path_is_prefix
from ..functions.text import fold
from .ranges import below, buckets, clip_overreach, closed, merge_blocks, point_in_range
from .reading import is_context, is_enumerated, is_unit

# Sizes of units and fragments, corpora that are read at their deepest sections, and how works' names end.
UNIT_MOST, FRAGMENT_BELOW, OUTLINE_LEAST = 1500, 20, 20
DEEPEST = ("att", "tik", "nrf")
WORK_TAIL = r"(?i)(?:ṭīkā|tika|aṭṭhakathā|atthakatha)$"
GROUP_TAILS = ("vaggo", "vagga")


def ancestors(sections: DataFrame, key: str) -> DataFrame:
    """(id, a_id, a_title, a_start, a_end, depth): each section with itself and those above it by path and range."""
    s = closed(sections)
    up = s.select(key, F.col("id").alias("a_id"), F.col("title").alias("a_title"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.col("path").alias("head"), F.size("path").alias("depth"))
    heads = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i)))
    own = s.filter(F.size("path") > 0).select(key, "id", "start", "end", heads.alias("head"))
    return own.join(up, [key, "head"]).filter("a_start <= start and a_end >= end").drop("head", "start", "end")


def reader_sections(sections: DataFrame, key: str, corpus: str = "corpus") -> DataFrame:
    """(id, unit, exact): the section that is read for each section.

    Of corpora read at their deepest sections it is the section itself. Else it is the smallest unit above it (or it),
    units that stand for themselves before those that need their context; without a unit, a fragment that is not numbered
    goes to the smallest other section above it, if that is not too long; all others are read as they are."""
    up = ancestors(sections, key).withColumns({"span": F.col("a_end") - F.col("a_start") + 1, "unit": is_unit(F.col("a_title"), F.col("a_start"), F.col("a_end")), "context": is_context(F.col("a_title"))})
    small = lambda tier: F.struct(tier.alias("tier"), F.col("span").alias("span"), (-F.col("depth")).alias("depth"), F.col("a_id").alias("id"))
    best = up.groupBy("id").agg(
        F.min(F.when(F.col("unit"), small(F.col("context").cast("int")))).alias("best"),
        F.min(F.when(F.col("a_id") != F.col("id"), small(F.lit(0)))).alias("next"),
    )
    s = closed(sections).select("id", F.col(corpus).alias("__corpus"), "title", (F.col("end") - F.col("start") + 1).alias("own"), is_unit(F.col("title"), F.col("start"), F.col("end")).alias("self_unit"))
    rows = s.join(best, "id", "left")
    fragment = (F.col("own") < FRAGMENT_BELOW) & ~is_enumerated(F.col("title")) & (F.col("next.span") <= UNIT_MOST)
    deepest = F.col("__corpus").isin(*DEEPEST)
    unit = F.when(deepest, F.col("id")).when(F.col("best").isNotNull(), F.col("best.id")).when(fragment, F.col("next.id")).otherwise(F.col("id"))
    exact = F.when(deepest, F.col("self_unit")).otherwise(F.col("best").isNotNull())
    return rows.select("id", unit.alias("unit"), exact.alias("exact"))


def reader_units(sections: DataFrame, key: str) -> DataFrame:
    """reader_sections with the unit's clipped range."""
    ranges = clip_overreach(sections, key).select(F.col("id").alias("unit"), "start", "end", "clipped")
    return reader_sections(sections, key).join(ranges, "unit")


def _layer(rows: DataFrame) -> DataFrame:
    """Of (id, child, depth, ...) each id's shallowest depth with at least two children."""
    n = rows.withColumn("n", F.count("*").over(Window.partitionBy("id", "depth"))).filter("n >= 2")
    return n.withColumn("least", F.min("depth").over(Window.partitionBy("id"))).filter("depth = least").drop("n", "least")


def outlines(sections: DataFrame, key: str, parents: DataFrame | None = None) -> DataFrame:
    """(id, child, c_start, c_end): one flat layer of each section of OUTLINE_LEAST passages or more.

    It is the shallowest layer below the section by path. A section whose path leads to none takes, by ranges alone, the
    shallowest layer whose sections do not overlap, each that begins inside the one kept before left out. parents: those
    sections whose outlines are asked, all if null."""
    s = closed(sections)
    own = F.col("end") - F.col("start") + 1
    long_ = (s if parents is None else closed(parents)).filter(own >= OUTLINE_LEAST)
    by_path = _layer(below(sections, key, long_).withColumn("own", own).filter("c_end - c_start + 1 < own").select("id", "child", "c_start", "c_end", "depth"))
    rest = long_.join(by_path, "id", "left_anti").select(key, "id", "start", "end", own.alias("own"))
    child = s.select(key, F.col("id").alias("child"), F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.size("path").alias("depth"))
    met = rest.withColumn("__b", buckets(F.col("start"), F.col("end"), 64)).join(child.withColumn("__b", F.floor(F.col("c_start") / 64)), [key, "__b"])
    inside = met.filter("c_start >= start and c_end <= end and child <> id and c_end - c_start + 1 < own").select("id", "child", "c_start", "c_end", "depth")

    def apart(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], None
        for x in pdf.sort_values(["c_start", "c_end", "child"]).itertuples():
            if last is None or x.c_start > last:
                kept.append(x.Index)
                last = x.c_end
        return pdf.loc[kept]

    flat = _layer(inside.groupBy("id", "depth").applyInPandas(apart, inside.schema))  # one section's children of one depth
    return by_path.unionByName(flat).select("id", "child", "c_start", "c_end")


def outline_entries(sections: DataFrame, blocks: DataFrame, key: str, parents: DataFrame | None = None) -> DataFrame:
    """(id, child, anchor, passages): outlines whose entries have a block (key, start) in their range to go to, the first
    one; at least two of them."""
    rows = outlines(sections, key, parents).join(closed(sections).select("id", key), "id")
    at = rows.withColumn("__b", buckets(F.col("c_start"), F.col("c_end"), 64)).join(blocks.select(key, F.col("start").alias("anchor")).withColumn("__b", F.floor(F.col("anchor") / 64)), [key, "__b"]).filter("anchor between c_start and c_end")
    found = at.groupBy("id", "child", (F.col("c_end") - F.col("c_start") + 1).alias("passages")).agg(F.min("anchor").alias("anchor"))
    return found.withColumn("n", F.count("*").over(Window.partitionBy("id"))).filter("n >= 2").select("id", "child", "anchor", "passages")


def without_repeats(path: Column) -> Column:
    """No item that an earlier one repeats, whatever its case; the last one stays."""
    last = F.size(path) - 1
    kept = F.filter(path, lambda x, i: (i == last) | ~F.exists(F.slice(path, 1, i), lambda y: F.lower(y) == F.lower(x)))
    return F.when(F.size(path) > 0, kept).otherwise(path)


def book_stem(title: Column) -> Column:
    return F.lower(F.trim(F.get(F.split(F.trim(title), "[-–]", 2), F.lit(0))))


def fixed_paths(sections: DataFrame, key: str) -> DataFrame:
    """(id, path): citation paths without repeats, the name of a work put right: the first item but the last that is a work's
    name of the same book gives way to the smallest work that holds the section, unless that is named already."""
    s = closed(sections)
    works = s.filter(F.col("title").rlike(WORK_TAIL)).select(key, F.col("title").alias("work"), F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    at = s.withColumn("__b", F.floor(F.col("start") / 64)).join(works.withColumn("__b", buckets(F.col("w_start"), F.col("w_end"), 64)), [key, "__b"])
    held = at.filter((F.col("w_start") <= F.col("start")) & (F.col("w_end") >= F.col("end")) & (F.lower("work") != F.lower("title"))).groupBy("id").agg(F.min(F.struct((F.col("w_end") - F.col("w_start")).alias("span"), "w_start", "work"))["work"].alias("work"))
    rows = s.select("id", without_repeats(F.col("path")).alias("path")).join(held, "id", "left")
    named = F.exists("path", lambda x: F.lower(x) == F.lower("work"))
    fits = F.transform(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), lambda x: (book_stem(x) == book_stem(F.col("work"))) & x.rlike(WORK_TAIL))
    place = F.array_position(fits, F.lit(True))
    put = F.transform("path", lambda x, i: F.when(i == place - 1, F.col("work")).otherwise(x))
    return rows.select("id", F.when(F.col("work").isNotNull() & ~named & (place > 0), put).otherwise(F.col("path")).alias("path"))


def with_occurrence(path: Column, occurrence: Column, occurrences: Column, label: str = "{} ({}/{})") -> Column:
    """A path with which of its equals it is, where there are several."""
    a, b, c, d = (label.split("{}") + [""] * 4)[:4]
    return F.when(occurrences > 1, F.concat(F.lit(a), path, F.lit(b), occurrence.cast("string"), F.lit(c), occurrences.cast("string"), F.lit(d))).otherwise(path)


def reader_documents(sections: DataFrame, passages: DataFrame, key: str, joins: Column) -> DataFrame:
    """(id, block, start, ids, text): each section's display blocks within its clipped range. passages (key, sort_order,
    text); joins: whether a passage runs on with its neighbour."""
    ranges = clip_overreach(sections, key).select(key, "id", "start", "end")
    rows = point_in_range(passages.withColumn("__joins", joins), ranges, key, "sort_order")
    return merge_blocks(rows, "id", "sort_order", "sort_order", "text", F.col("__joins"))


def label_audit(sections: DataFrame, rows: DataFrame, key: str, label: str = r"^\s*(.+?)\s*\((\d+)\)") -> DataFrame:
    """Rows (key, id, sort_order, number: text, text) that are labelled with a number of another group than their own.

    A group is a section named as a chapter; its numbers are those of the passages in its range that are whole numbers."""
    groups = closed(sections).filter(reduce(lambda a, t: a | F.endswith(F.replace(fold(F.col("title")), F.lit(" "), F.lit("")), F.lit(t)), GROUP_TAILS, F.lit(False))).select(key, F.col("id").alias("group"), F.col("title").alias("group_title"), "start", "end")
    whole = F.when(F.col("number").rlike("^[0-9]+$"), F.col("number").cast("int"))
    numbered = rows.withColumn("__n", whole).filter("__n is not null")
    edges = point_in_range(numbered.select(key, "sort_order", "__n"), groups, key, "sort_order").groupBy(key, "group", "group_title").agg(F.min("__n").alias("lo"), F.max("__n").alias("hi"))
    held = numbered.withColumns({"label_text": F.regexp_extract("text", label, 1), "label_no": F.regexp_extract("text", label, 2).try_cast("int")}).filter("label_no is not null")
    edge = lambda n: edges.select(key, F.col("group_title").alias(f"{n}_title"), F.col("lo").alias(f"{n}_lo"), F.col("hi").alias(f"{n}_hi"))
    own, said = edge("own"), edge("label")  # a document's groups are its chapters
    met = held.join(own, key).filter("__n between own_lo and own_hi").join(said, key).filter("label_no between label_lo and label_hi")
    first = Window.partitionBy("id").orderBy("own_lo", "own_hi", "label_lo", "label_hi")
    return met.withColumn("__k", F.row_number().over(first)).filter("__k = 1 and own_title <> label_title").select("id", "sort_order", F.col("__n").alias("number"), "own_title", "label_text", "label_no", "label_title")
