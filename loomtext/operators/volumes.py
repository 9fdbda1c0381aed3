"""Alignment of a printed volume to a text's units: anchors, boundaries and headings. A volume is one book, so that the
sequential steps run per volume."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import anchor_similarity
from .pages import numbers_agree, printed_number

# What a heading's likeness must reach and be ahead of the next by, and from where it is exact.
HEADING_LIKE, HEADING_AHEAD, HEADING_EXACT = 0.84, 0.06, 0.995


def monotone_path(score: np.ndarray) -> np.ndarray | None:
    """For each row a column, columns increasing strictly, with the largest sum; null if there are fewer columns than rows.
    Ties go to the columns found first."""
    rows, columns = score.shape
    if columns < rows:
        return None
    total, back = score[0].astype(float), []
    for r in range(1, rows):
        best, who = -np.inf, -1
        before, first = np.full(columns, -np.inf), np.full(columns, -1)
        for c in range(columns):  # the best strictly before c
            before[c], first[c] = best, who
            if total[c] > best:
                best, who = total[c], c
        back.append(first)
        total = before + score[r]
    c = int(np.argmax(total))
    out = [c]
    for first in reversed(back):
        c = int(first[c])
        out.append(c)
    return np.array(out[::-1])


def anchor_scores(units: DataFrame, candidates: DataFrame, volume: str) -> DataFrame:
    """(volume, unit, candidate, score) of a volume's units (volume, unit, anchor) and candidates (volume, candidate, block)."""
    return units.join(candidates, volume).select(volume, "unit", "candidate", anchor_similarity(F.col("anchor"), F.col("block")).alias("score"))


def anchor_path(scores: DataFrame, volume: str, least: float) -> DataFrame:
    """(volume, unit, candidate, score, weak): each unit's candidate on the best increasing path; weak: below `least`. A volume
    with fewer candidates than units has no rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="unit", columns="candidate", values="score", fill_value=0.0)
        at = monotone_path(table.to_numpy())
        name = pdf[volume].iloc[0]
        if at is None:
            return pd.DataFrame({volume: [], "unit": [], "candidate": [], "score": [], "weak": []})
        score = table.to_numpy()[np.arange(len(at)), at]
        return pd.DataFrame({volume: name, "unit": table.index, "candidate": table.columns[at], "score": score, "weak": score < least})

    kind = lambda c: scores.schema[c].dataType.simpleString()
    return scores.groupBy(volume).applyInPandas(run, f"{volume} {kind(volume)}, unit {kind('unit')}, candidate {kind('candidate')}, score double, weak boolean")


def between_anchors(scores: DataFrame, fixed: DataFrame, volume: str, least: float = 0.0) -> DataFrame:
    """anchor_path within the runs between fixed pairs (volume, unit, candidate), which are kept: a unit between two of them
    only takes candidates between theirs."""
    f = fixed.select(volume, F.col("unit").alias("f_unit"), F.col("candidate").alias("f_candidate"))
    runs = scores.select(volume, "unit").distinct().join(f, volume).groupBy(volume, "unit").agg(
        F.max(F.when(F.col("f_unit") <= F.col("unit"), F.col("f_unit"))).alias("run"), F.max(F.when(F.col("f_unit") <= F.col("unit"), F.col("f_candidate"))).alias("low"),
        F.min(F.when(F.col("f_unit") > F.col("unit"), F.col("f_candidate"))).alias("high"), F.max(F.col("f_unit") == F.col("unit")).alias("is_fixed"))
    open_ = scores.join(runs.filter("not is_fixed"), [volume, "unit"]).filter("(low is null or candidate > low) and (high is null or candidate < high)")
    keyed = open_.withColumn("__run", F.concat_ws(":", volume, F.coalesce("run", F.lit(-1)))).drop("run", "low", "high", "is_fixed")
    found = anchor_path(keyed.select(F.col("__run"), "unit", "candidate", "score"), "__run", least)
    named = keyed.select("__run", volume).distinct()
    kept = scores.join(fixed.select(volume, "unit", "candidate"), [volume, "unit", "candidate"]).select(volume, "unit", "candidate", "score", F.lit(False).alias("weak"))
    return found.join(named, "__run").select(volume, "unit", "candidate", "score", "weak").unionByName(kept)


def gapped_path(score: np.ndarray, gap: float = 0.05) -> np.ndarray:
    """For each row a column, columns not decreasing, with the largest sum of row-centred scores less `gap` for each column
    passed over."""
    centred = score - score.mean(axis=1, keepdims=True)
    rows, columns = score.shape
    at, back, total = np.arange(columns), [], centred[0].copy()
    for r in range(1, rows):
        lifted = total + gap * at  # staying or stepping on costs nothing, each further column costs gap
        far = np.maximum.accumulate(np.concatenate([[-np.inf, -np.inf], lifted[:-2]]))[:columns] if columns > 2 else np.full(columns, -np.inf)
        options = np.stack([total, np.concatenate([[-np.inf], total[:-1]]), far - gap * (at - 1)])
        kind = options.argmax(axis=0)
        far_at = np.array([int(np.argmax(lifted[: max(c - 1, 1)])) for c in at])
        back.append(np.choose(kind, [at, np.maximum(at - 1, 0), far_at]))
        total = options.max(axis=0) + centred[r]
    c = int(np.argmax(total))
    out = [c]
    for b in reversed(back):
        c = int(b[c])
        out.append(c)
    return np.array(out[::-1])


def numbered_candidates(pages: DataFrame, volume: str, page: str, text: str, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """(volume, page, line, numbers, block): the numbered paragraphs of a volume's pages, each with the lines up to the next."""
    rows = pages if first is None else pages.filter(F.col(page) >= first)
    rows = rows if last is None else rows.filter(F.col(page) < last)
    each = rows.select(volume, page, F.posexplode(F.split(text, "\n")).alias("line", "t")).withColumn("t", T.squeeze(F.col("t")))
    head = F.regexp_extract("t", r"^((?:\d+\s*\.\s*)+)", 1)
    w = Window.partitionBy(volume, page).orderBy("line")
    marked = each.withColumn("head", head).withColumn("k", F.count(F.when(F.col("head") != "", 1)).over(w)).filter("k > 0")
    parts = F.array_sort(F.collect_list(F.struct("line", "t")))
    out = marked.groupBy(volume, page, "k").agg(F.min("line").alias("line"), F.max("head").alias("head"), parts.alias("p"))
    return out.select(volume, page, "line", F.transform(F.regexp_extract_all("head", F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int")).alias("numbers"), F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("block"))


def nth_occurrence(left: DataFrame, right: DataFrame, volume: str, page: str, shift: int = 1) -> DataFrame:
    """Left candidates with the line of the facing page that has the same numbers, the same one of several."""
    w = Window.partitionBy(volume, page, "numbers").orderBy("line")
    a = left.withColumn("n", F.row_number().over(w))
    b = right.withColumn("n", F.row_number().over(w)).select(volume, (F.col(page) - shift).alias(page), "numbers", "n", F.col("line").alias("facing_line"))
    return a.join(b, [volume, page, "numbers", "n"], "left").drop("n")


def heading_blocks(lines: DataFrame, page: str, at: str, text: str, upper: float = 0.55) -> DataFrame:
    """(page, block, start, heading): neighbouring capital lines without other text between them."""
    w = Window.partitionBy(page).orderBy(at)
    rows = lines.withColumn("__t", T.squeeze(F.col(text))).filter("__t <> ''").withColumn("__h", T.uppercase_ratio(F.col("__t")) >= upper)
    rows = rows.withColumn("block", F.sum((F.col("__h") & ~F.coalesce(F.lag("__h").over(w), F.lit(False))).cast("int")).over(w)).filter("__h")
    parts = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col("__t").alias("t"))))
    return rows.groupBy(page, "block").agg(parts.alias("p")).select(page, "block", F.get("p", F.lit(0))["at"].alias("start"), F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("heading"))


def heading_pairs(left: DataFrame, right: DataFrame, page: str) -> DataFrame:
    """Headings of facing pages by their order, for pages with as many on both sides; right pages come one later."""
    count = lambda rows: rows.withColumn("__n", F.count("*").over(Window.partitionBy(page)))
    r = count(right).select((F.col(page) - 1).alias(page), "block", "__n", F.col("start").alias("right_start"), F.col("heading").alias("right_heading"))
    return count(left).join(r, [page, "block", "__n"]).drop("__n")


def increasing(starts: DataFrame, volume: str, order: str, page: str, at: str) -> DataFrame:
    """(volume, ok): whether a volume's unit starts go forward strictly."""
    w = Window.partitionBy(volume).orderBy(order)
    here = F.struct(F.col(page).alias("p"), F.col(at).alias("a"))
    return starts.withColumn("__bad", F.lag(here).over(w) >= here).groupBy(volume).agg((~F.coalesce(F.bool_or("__bad"), F.lit(False))).alias("ok"))


def likeness(a: str, b: str) -> float:
    """Share of matching blocks in both texts."""
    return SequenceMatcher(None, a, b).ratio()


def find_headings(units: DataFrame, lines: DataFrame, volume: str) -> DataFrame:
    """(volume, unit, page, line, score): where units' headings are printed.

    units (volume, unit, title, stem), lines (volume, page, line, stem). A stem that is printed on as many pages as units
    have it goes to them in order. Of the rest, a line is a unit's candidate if it is like enough, clearly ahead of the next
    unit and, short of an exact match, of the same number; the first page's best candidate is taken, exact ones before others."""
    exact = lines.join(units.select(volume, "stem").distinct(), [volume, "stem"], "left_semi")
    pages = exact.groupBy(volume, "stem", "page").agg(F.min("line").alias("line")).withColumn("k", F.row_number().over(Window.partitionBy(volume, "stem").orderBy("page"))).withColumn("n", F.count("*").over(Window.partitionBy(volume, "stem")))
    same = units.withColumn("k", F.row_number().over(Window.partitionBy(volume, "stem").orderBy("unit"))).withColumn("n", F.count("*").over(Window.partitionBy(volume, "stem")))
    sure = same.join(pages, [volume, "stem", "k", "n"]).select(volume, "unit", "page", "line", F.lit(1.0).alias("score"))

    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b)])

    # at HEADING_LIKE lengths differ by less than half
    near = F.length("stem") * 2 >= F.length("u_stem"), F.length("u_stem") * 2 >= F.length("stem")
    pairs = lines.join(units.select(volume, "unit", "title", F.col("stem").alias("u_stem")), volume).filter(near[0] & near[1]).withColumn("score", like("stem", "u_stem"))
    w = Window.partitionBy(volume, "page", "line").orderBy(F.desc("score"), F.desc("unit"))
    best = pairs.withColumn("k", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0))).filter((F.col("k") == 1) & (F.col("score") >= HEADING_LIKE) & (F.col("score") - F.col("second") >= HEADING_AHEAD))
    fit = best.filter((F.col("score") >= HEADING_EXACT) | numbers_agree(F.col("line"), F.col("title")))
    one = Window.partitionBy(volume, "unit").orderBy((F.col("score") < HEADING_EXACT).cast("int"), "page", F.desc("score"), "line")
    rest = fit.join(sure, [volume, "unit"], "left_anti").withColumn("k", F.row_number().over(one)).filter("k = 1")
    return sure.unionByName(rest.select(volume, "unit", "page", "line", "score"))


def last_boundary(pages: DataFrame, volume: str, page: str, text: str, stem: Column, ended: str = "nitthit") -> DataFrame:
    """(volume, end_page, named): behind which page a volume's last unit ends: the first page with a line that says that the
    named unit is ended, or else the first that says that something is."""
    line = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(T.fold(x), "[^a-z0-9]+", ""))
    rows = pages.withColumn("__any", F.exists(line, lambda x: F.contains(x, F.lit(ended)))).withColumn("__named", F.exists(line, lambda x: F.contains(x, F.lit(ended)) & F.contains(x, stem)))
    out = rows.groupBy(volume).agg(F.min(F.when(F.col("__named"), F.col(page))).alias("a"), F.min(F.when(F.col("__any"), F.col(page))).alias("b"))
    return out.filter("b is not null").select(volume, (F.coalesce("a", "b") + 1).alias("end_page"), F.col("a").isNotNull().alias("named"))


def heading_offset(page: Column, number: Column, upper: float = 0.5, early: int = 800) -> Column:
    """struct(at, line): where on a facing page a unit's heading is: the first capital line with the number; without such a
    one the only capital line; for a unit without number the last one that begins early."""
    lines = F.split(page, "\n")
    starts = F.transform(lines, lambda x, i: F.struct(F.aggregate(F.slice(lines, 1, i), F.lit(0), lambda a, y: a + F.length(y) + 1).alias("at"), T.squeeze(x).alias("line")))
    heads = F.filter(starts, lambda x: F.length(x["line"]).between(4, 120) & (T.uppercase_ratio(x["line"]) >= upper))
    same = F.filter(heads, lambda x: printed_number(x["line"]) == number)
    soon = F.filter(heads, lambda x: x["at"] <= early)
    return F.when(number.isNotNull() & (F.size(same) > 0), F.get(same, F.lit(0))).when(number.isNotNull(), F.when(F.size(heads) == 1, F.get(heads, F.lit(0)))).otherwise(F.get(F.when(F.size(soon) > 0, soon).otherwise(heads), F.when(F.size(soon) > 0, F.size(soon)).otherwise(F.size(heads)) - 1))


def first_of_pairs(matches: DataFrame, passage: str, order: str) -> DataFrame:
    """The first match of each passage."""
    return matches.withColumn("__n", F.row_number().over(Window.partitionBy(passage).orderBy(order))).filter("__n = 1").drop("__n")


def is_work_title(title: Column, unnumbered: bool = False, more: tuple[str, ...] = ()) -> Column:
    """Numbered titles that end like a work; `unnumbered` and further endings for collections that need them."""
    tails = "|".join(("suttam", "sutta", "suttanta", "suttantam", *more))
    named = T.fold(title).rlike(f"(?:{tails})$")
    return named if unnumbered else named & F.trim(title).rlike(r"^\(?\d")


def is_whole_unit(title: Column, tails: tuple[str, ...]) -> Column:
    return F.trim(title).rlike(r"^\(?\d") & T.fold(title).rlike(f"(?:{'|'.join(tails)})$")


def volume_units(sections: DataFrame, rules: DataFrame, volume: str) -> DataFrame:
    """Sections that are units by their volume's rule (volume, level, tail, first, last): a level, an ending of the stem and a
    range of positions, each null where it does not matter."""
    stem = T.heading_stem(F.col("title"))
    free = lambda c, ok: F.col(c).isNull() | ok
    r = rules.select(volume, *(F.col(c).alias(f"r_{c}") for c in ("level", "tail", "first", "last")))
    fits = free("r_level", F.col("level") == F.col("r_level")) & free("r_first", F.col("start") >= F.col("r_first")) & free("r_last", F.col("start") <= F.col("r_last"))
    rows = sections.withColumn("__stem", stem).join(r, volume).filter(fits).filter("r_tail is null or endswith(__stem, r_tail)")
    return rows.drop("__stem", "r_level", "r_tail", "r_first", "r_last").dropDuplicates([volume, "id"])
