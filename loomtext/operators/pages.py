"""Texts of printed and web pages: cleaning, splitting into works and paragraphs, mending, and printed numbers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .reading import join_fragments

# The columns in which a paragraph's first line begins, where layouts put page numbers, and least lengths.
INDENT_LEAST, INDENT_MOST, FAR, PARAGRAPH_LEAST, HEADING_BELOW, UPPER = 8, 16, 100, 12, 100, 0.72
ROMANS = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split()
MARKED_LOWER = "āīūṅñṭḍṇḷṃṁ"


def lines(c: Column, noise: str = r"^\s*$", sub_heading: str | None = None, most: int = 90) -> Column:
    """A page's lines with single spaces, without blank ones, noise and short headings inside."""
    text = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)</p\s*>|<br\s*/?>|</h[1-6]>|</div>|</tr>|</li>", "\n"), r"<[^>]+>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    each = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t ]+", " ")))
    keep = lambda x: (x != "") & ~x.rlike(noise) & (~(x.rlike(sub_heading) & (F.length(x) <= most)) if sub_heading else F.lit(True))
    return F.filter(each, keep)


def split_works(pages: DataFrame, key: str, page: str, text: str, marker: str = r"^\s*([IVXLCDM]+)\.\s+(.*)$", grouped: bool = True) -> DataFrame:
    """(key, group, index, printed, heading, text): the works of a collection's pages in reading order.

    A line with a Roman numeral begins a work; its number in the group is by order, since printed ones may be wrong. A
    numeral of one begins a group. Lines before the first work are left out. A collection is one book."""
    every = pages.select(key, page, F.posexplode(lines(F.col(text))).alias("at", "line"))
    number = F.when(F.regexp_extract("line", marker, 1) != "", T.roman(F.regexp_extract("line", marker, 1)))
    w = Window.partitionBy(key).orderBy(page, "at")
    rows = every.withColumn("printed", number).withColumn("work", F.count("printed").over(w)).filter("work > 0")
    opens = (F.col("printed") == 1) | (F.col("work") == 1) if grouped else F.col("work") == 1
    rows = rows.withColumn("group", F.sum((F.col("printed").isNotNull() & opens).cast("int")).over(w))
    heading = F.trim(F.regexp_replace(F.regexp_extract("line", marker, 2), r"\s+", " "))
    part = F.struct(F.col(page).alias("p"), "at", F.when(F.col("printed").isNotNull(), heading).otherwise(F.col("line")).alias("line"))
    works = rows.groupBy(key, "group", "work").agg(F.max("printed").alias("printed"), F.max(F.when(F.col("printed").isNotNull(), heading)).alias("heading"), F.array_sort(F.collect_list(part)).alias("ls"))
    index = F.row_number().over(Window.partitionBy(key, "group").orderBy("work"))
    return works.select(key, "group", index.alias("index"), "printed", "heading", F.array_join(F.filter(F.transform("ls", lambda x: x["line"]), lambda x: x != ""), "\n").alias("text"))


def without_notes(c: Column, footer: str, notes: Sequence[str]) -> Column:
    """A text's lines up to the footer, without those that are notes."""
    each = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    found = F.array_position(F.transform(each, lambda x: x.rlike(footer)), F.lit(True))
    kept = F.when(found > 0, F.slice(each, 1, F.greatest(found.cast("int") - 1, F.lit(0)))).otherwise(each)
    return F.array_join(F.filter(kept, lambda x: ~reduce(lambda a, n: a | x.rlike(n), notes, F.lit(False))), "\n")


def without_running_head(c: Column) -> Column:
    """Without the blank lines and page numbers at a page's top and the line behind them, unless that is numbered."""
    bare = F.regexp_replace(c, r"^(?:[ \t\r]*(?:\d{1,4})?[ \t\r]*(?:\n|$))+", "")
    return F.when(bare.rlike(r"^\s*\d{1,4}\s*\."), bare).otherwise(F.regexp_replace(bare, r"^[^\n]*(?:\n|$)", ""))


def clean_page(c: Column, heads: Sequence[str], patterns: Sequence[tuple[str, str]] = (), most: int = 120) -> Column:
    """A page's paragraphs, each on a line of its own kind: no page numbers, no lines of at most `most` characters that begin
    like a running head or match a pattern (and not its exception). Lines of a paragraph are joined; blank ones part them."""
    each = F.transform(F.split(T.artifacts(c), "\n"), T.squeeze)

    def head(x: Column) -> Column:
        low = F.lower(x)
        said = reduce(lambda a, h: a | F.startswith(low, F.lit(h)), heads, F.lit(False))
        for pattern, unless in patterns:
            said = said | (low.rlike(pattern) & (~F.contains(low, F.lit(unless)) if unless else F.lit(True)))
        return x.rlike(r"^\d{1,4}$") | ((F.length(x) <= most) & (x != "") & said)

    kept = F.array_join(F.filter(each, lambda x: ~head(x)), "\n")
    return F.array_join(F.filter(F.transform(F.split(kept, r"\n\n+"), lambda p: F.trim(F.replace(p, F.lit("\n"), F.lit(" ")))), lambda p: p != ""), "\n\n")


def uppercase(text: str) -> float:
    letters = [x for x in text if x.isalpha()]
    return sum(x.isupper() for x in letters) / len(letters) if letters else 0.0


def indented_paragraphs(layout: str) -> list[str]:
    """Paragraphs of a page whose layout keeps columns. A first line is set in by INDENT_LEAST to INDENT_MOST columns, its
    other lines begin at the margin; what stands elsewhere behind a blank line is a heading and ends the paragraph; a note
    at the margin behind a blank line ends the page."""
    out: list[str] = []
    own: list[str] = []

    def close() -> None:
        text = " ".join(" ".join(own).split())
        if len(text) >= PARAGRAPH_LEAST and not (len(text) < HEADING_BELOW and uppercase(text) >= UPPER):
            out.append(text)
        own.clear()

    blank = False
    for line in layout.splitlines():
        text, column = line.strip(), len(line) - len(line.lstrip())
        if not text:
            blank = True
            continue
        if column > FAR or re.fullmatch(r"\d{1,4}", text):
            blank = False
            continue
        if INDENT_LEAST <= column <= INDENT_MOST:
            close()
            own.append(text)
        elif own and column == 0:
            if blank and re.match(r"(?:\d+|\[[a-z]\])\s", text, re.I):
                break
            own.append(text)
        elif own and blank:
            close()
        blank = False
    close()
    return out


def in_python(rows: DataFrame, key: str, text: str, f: Callable[[str], list[str]], name: str = "part") -> DataFrame:
    """(key, part_no, part) of the parts that f makes of each text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(k, i, x) for k, t in zip(part[key], part[text]) for i, x in enumerate(f(t or ""))]
            if out:
                yield pd.DataFrame(out, columns=[key, f"{name}_no", name])

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {name}_no int, {name} string")


def merged_paragraphs(text: str, least: int = 40) -> list[str]:
    """Paragraphs of which a short one joins the one behind it, and a short last one the one before."""
    out: list[str] = []
    held = ""
    for p in (" ".join(x.split()) for x in re.split(r"\n\s*\n|\n", text)):
        if p:
            held = f"{held} {p}".strip()
            if len(held) >= least:
                out.append(held)
                held = ""
    if held:
        out[-1:] = [f"{out[-1]} {held}"] if out else [held]
    return out


def joins(parts: Sequence[str], known: set[str], sure: set[str], kept: set[tuple[str, ...]], common: set[str], marked: str = MARKED_LOWER) -> bool:
    """Whether fragments are one word. Pairs in `kept` never are; a name cut before a marked letter and words in `sure`
    always are; known words are, unless all fragments are known and one is common; else a fragment of letters before a
    short marked one is."""
    low = tuple(p.lower() for p in parts)
    word = "".join(low)
    if low in kept:
        return False
    pair = len(parts) == 2 and parts[1][:1] in marked and bool(re.fullmatch(rf"[A-Za-z{marked}{marked.upper()}]+", parts[0]))
    if pair and parts[0][:1].isupper() or word in sure:
        return True
    if word in known:
        return not (all(p in known for p in low) and any(p in common for p in low))
    return bool(pair and len(parts[1]) <= 2)


def mended(text: str, known: set[str], most: int = 5) -> str:
    return " ".join(join_fragments(text.split(" "), known, most))


def spacing_audit(rows: DataFrame, key: str, text: str, legitimate: Sequence[tuple[str, str]] = (), vowels: str = "aeiouy") -> DataFrame:
    """(key, left, right, no_vowel, joined): neighbouring words that may be one. no_vowel: the left one has no vowel and the
    right one begins with a marked letter; joined: how often the two occur as one word, where one has three letters or less.

    Words are counted over all texts; only pairs that can be suspect are joined to the counts."""
    words = rows.select(key, F.regexp_extract_all(text, F.lit(r"(\p{L}[\p{L}\p{M}]*)(?= |[^\p{L}\p{M}]|$)"), F.lit(1)).alias("w"))
    counts = words.select(F.explode("w").alias("x")).groupBy(F.lower("x").alias("word")).agg(F.count("*").alias("n"))
    runs = F.flatten(F.transform(F.transform(F.split(text, r"[^\p{L}\p{M} ]+|  +"), lambda r: F.filter(F.split(r, " "), lambda x: x != "")), lambda w: F.arrays_zip(w.alias("0"), F.slice(w, 2, 1 << 20).alias("1"))))
    pairs = rows.select(key, F.explode(runs).alias("p")).select(key, F.col("p")["0"].alias("left"), F.col("p")["1"].alias("right")).filter("right is not null")
    pairs = pairs.filter(~F.struct(F.lower("left").alias("a"), F.lower("right").alias("b")).isin([F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in legitimate])) if legitimate else pairs
    first = F.substring("right", 1, 1)
    marked = (first > "\u007f") & (T.strip_marks(first) != F.lower(first))  # plain letters, nearly all, are told by one byte
    bare = marked & ~F.regexp_replace(T.strip_marks(F.col("left")), f"[^{vowels}]", "").rlike(".")
    some = pairs.withColumn("no_vowel", bare).withColumn("short", (F.length("left") <= 3) | (F.length("right") <= 3)).filter("no_vowel or short")
    # long pairs have no word to meet; a key of their own, with a space, keeps them from one task
    whole = F.when(F.col("short"), F.lower(F.concat("left", "right"))).otherwise(F.concat(F.lit(" "), "left", F.lit(" "), "right"))
    met = some.join(counts, whole == F.col("word"), "left")
    return met.select(key, "left", "right", "no_vowel", F.coalesce("n", F.lit(0)).alias("joined")).filter("no_vowel or joined > 0")


def printed_number(line: Column) -> Column:
    """The last of the numbers that a printed heading begins with, Roman ones up to twenty too; null without one."""
    arabic = F.regexp_extract(line, r"^\s*((?:\(?\d+\)?\s*\.\s*)+)", 1)
    numbers = F.regexp_extract_all(arabic, F.lit(r"(\d+)"), F.lit(1))
    roman = F.lower(F.regexp_extract(line, r"(?i)^\s*([IVXLCDM]+)\s*[.)]", 1))
    place = F.array_position(F.array(*map(F.lit, ROMANS)), roman)
    return F.when(arabic != "", F.element_at(numbers, -1).cast("int")).when(place > 0, place.cast("int"))


def title_number(title: Column) -> Column:
    return F.regexp_extract(title, r"^\s*(\d+)\s*[.\-]", 1).try_cast("int")


def numbers_agree(line: Column, title: Column) -> Column:
    """Both have a number and it is the same."""
    return F.coalesce(printed_number(line) == title_number(title), F.lit(False))


def unit_key(path: Column, title: Column, chapter: str, part: str) -> Column:
    """A unit's printed key chapter.part.number by its path: the number of the last item that matches `chapter`, that of the
    last behind it that matches `part`, and the title's; null without chapter or title number."""
    number = lambda x: F.regexp_extract(x, r"^(\d+)\.\s+", 1)
    last = lambda p: F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(path, lambda x: (number(x) != "") & F.lower(x).rlike(p)), number)), -1)
    own = F.regexp_extract(title, r"^([\d-]+)\.", 1)
    return F.when((last(chapter) != "") & (own != ""), F.array_join(F.filter(F.array(last(chapter), last(part), own), lambda x: x != ""), "."))


def aliased_stem(stem: Column, volume: Column, aliases: dict[tuple[str, str], str]) -> Column:
    """A heading's stem, or the stem that a volume prints in its place."""
    return reduce(lambda out, kv: F.when((volume == kv[0][0]) & (stem == kv[0][1]), kv[1]).otherwise(out), aliases.items(), stem)


def compact(c: Column) -> Column:
    """Letters alone, folded: bears broken spaces and marks."""
    return F.regexp_replace(T.fold(T.artifacts(c)), r"[^\p{L}]+", "")


def coverage_tokens(c: Column) -> Column:
    """Distinct words of two plain letters or digits and more."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}\p{M}]+)"), F.lit(1)), lambda w: F.regexp_replace(T.strip_marks(w), "[^a-z0-9]+", "")), lambda w: F.length(w) >= 2))


def coverage_compact(c: Column) -> Column:
    return F.regexp_replace(T.strip_marks(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def page_audit(pages: DataFrame, key: str, first: str, second: str, least: float = 0.995) -> DataFrame:
    """(key, engine, text, covered, status): which of two readings of a page is taken. The second one is, where it has words
    that the first lacks and lacks none of the first's; a page whose readings contradict each other, or whose chosen text
    covers less than `least` of the second's words, is for review."""
    a, b = F.coalesce(first, F.lit("")), F.coalesce(second, F.lit(""))
    rows = T.computed(pages.select(key, a.alias("a"), b.alias("b")), ta=coverage_tokens(F.col("a")), tb=coverage_tokens(F.col("b")), ca=coverage_compact(F.col("a")), cb=coverage_compact(F.col("b")))
    lacks = lambda tokens, blob: F.filter(tokens, lambda w: ~F.contains(F.col(blob), w))
    rows = rows.withColumns({"la": lacks("tb", "ca"), "lb": lacks("ta", "cb")})
    take = (F.size("la") > 0) & (F.size("lb") == 0) & (F.trim("b") != "")
    missing = F.when(take, F.size(lacks("tb", "cb"))).otherwise(F.size("la"))
    covered = F.round(1 - missing / F.greatest(F.size("tb"), F.lit(1)), 4)
    bad = (covered < least) | ((F.size("la") > 0) & (F.size("lb") > 0)) | ((F.size("tb") == 0) & (F.trim("a") == ""))
    return rows.select(key, F.when(take, "second").otherwise("first").alias("engine"), F.when(take, F.col("b")).otherwise(F.col("a")).alias("text"), covered.alias("covered"), F.when(bad, "review").otherwise("pass").alias("status"))


def vietnamese(c: Column, marked: str = "ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ", more_than: int = 30) -> Column:
    """Whether a text has more than `more_than` letters of the kind."""
    return F.length(F.regexp_replace(F.lower(c), f"[^{marked}]", "")) > more_than
