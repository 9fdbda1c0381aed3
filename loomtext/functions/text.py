"""Text functions as column expressions; `compose` alone needs Python."""

from __future__ import annotations

import itertools
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Invisible characters that are removed, letters folded to ASCII, and words without content.
INVISIBLE = "[\u00AD\u200B-\u200F\u2060\uFEFF]"
MARKED, PLAIN = "āīūṅñṭḍṇḷṃṁ", "aiunntdnlmm"
STOPWORDS = (
    "aha ahosi api assa atha atthi ayam bhagava bhante bhikkhave ca ce eva evam hi hoti honti idam idha iti kho me na nam no pana puna "
    "sa santi seyyathidam so ta tam tassa tatha tattha te tena va vo vuccati vutta ya yadi yam yatha yena yo the and for that this with "
    "from was were are have has but all his her its who what when where how why they them there then not you any"
).split()
QUESTION_WORDS = "tim cho toi bai kinh doan noi ve cua su la gi khai niem dinh nghia giai thich the nao trong nhung cac mot nguoi".split()
NOT_WORD = r"[^\p{L}\p{N}_\s-]"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def compose(c: Column) -> Column:
    """NFC of any text; needs Python. `composed` does without, for most scripts."""

    @F.pandas_udf("string")
    def nfc(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return nfc(c)


def _clusters() -> dict[str, str]:
    """Letters with marks in all their equal spellings, and their composed forms, from the Unicode data."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x900, 0x1100), *range(0x1E00, 0x1F00), *range(0x3040, 0x3100)):
        char = chr(code)
        base, *marks = unicodedata.normalize("NFD", char)
        if not marks or unicodedata.normalize("NFC", char) != char:
            continue
        for order in itertools.permutations(marks):
            for k in range(len(marks)):
                spelling = unicodedata.normalize("NFC", base + "".join(order[:k])) + "".join(order[k:])
                if unicodedata.normalize("NFC", spelling) == char:
                    out[spelling] = char
    return out


CLUSTERS = _clusters()


def composed(c: Column) -> Column:
    """NFC in the JVM of Latin, Greek, Cyrillic, Indic and Japanese letters: those followed by marks, in canonical order, are
    looked up and their text is joined again; texts without marks pass."""
    known = F.from_json(F.lit(json.dumps(CLUSTERS)), "map<string,string>")
    each = F.transform(F.regexp_extract_all(c, F.lit(r"(?s)(\P{M}\p{M}+|\P{M}+(?!\p{M})|\p{M}+)"), F.lit(1)), lambda x: F.coalesce(F.try_element_at(known, x), *(F.concat(F.try_element_at(known, F.substring(x, 1, n)), F.substring(x, n + 1, 1 << 20)) for n in (3, 2)), x))
    return F.when(c.rlike(r"\p{M}"), F.array_join(each, "")).otherwise(c)


def fold(c: Column) -> Column:
    """Matching form: no invisible characters, composed, lower case, folded letters, other marks to spaces, single spaces."""
    return squeeze(F.regexp_replace(F.translate(F.lower(composed(F.regexp_replace(c, INVISIBLE, ""))), MARKED, PLAIN), NOT_WORD, " "))


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once a row, wherever they are used: a filter on them is not moved below."""
    for name, c in columns.items():
        rows = rows.select(*(x for x in rows.columns if x != name), F.explode(F.array(c)).alias(name))
    return rows


def _plain_letters() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, from the Unicode data."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.combining(x) for x in base[1:]):
            pairs[chr(code)] = base[0]
    return "".join(pairs) + "đĐ", "".join(pairs.values()) + "dD"


LATIN, BASE = _plain_letters()


def strip_marks(c: Column) -> Column:
    """No diacritics, lower case."""
    return F.lower(F.translate(F.regexp_replace(c, r"\p{M}+", ""), LATIN, BASE))


def words(c: Column) -> Column:
    """Of a folded text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


# Fixed value: where sentences end.
BOUNDARY = r"(?:\r?\n)+|[.!?;؛।॥]+\s*"


def segments(c: Column) -> Column:
    """Sentences or lines of two words or more; the whole text if there is none."""
    parts = F.transform(F.split(c, BOUNDARY), lambda x: F.regexp_replace(x, "^[ \t‘’“”\"'-]+|[ \t‘’“”\"'-]+$", ""))
    long_ = F.filter(parts, lambda x: F.size(F.split(squeeze(x), " ")) >= 2)
    return F.when(F.size(long_) > 0, long_).when(F.trim(c) != "", F.array(F.trim(c))).otherwise(F.array().cast("array<string>"))


def latin_ratio(c: Column) -> Column:
    """Share of a text's words in plain ASCII letters."""
    w = words(fold(c))
    return F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.filter(w, lambda x: x.rlike("^[a-z-]+$"))) / F.size(w))


def content_tokens(c: Column, least: int = 3, most: int = 24) -> Column:
    found = F.transform(words(fold(c)), lambda w: F.regexp_replace(w, "^-+|-+$", ""))
    return F.slice(F.array_distinct(F.filter(found, lambda w: (F.length(w) >= least) & w.rlike("^[a-z]+$") & ~w.isin(STOPWORDS))), 1, most)


def tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(strip_marks(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(QUESTION_WORDS))


def long_stems(terms: Column, chars: int = 7, least: int = 9) -> Column:
    """Prefixes of long compounds."""
    return F.array_distinct(F.transform(F.filter(terms, lambda t: F.length(t) >= least), lambda t: F.substring(t, 1, chars)))


def strip_tags(c: Column) -> Column:
    """Text of HTML with paragraphs as lines."""
    text = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?i)</(p|div|h[1-6]|li|tr)\s*>|<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    lines = F.transform(F.split(text, "\n"), squeeze)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def uppercase_ratio(c: Column) -> Column:
    """Of a text's letters."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(letters == 0, 0.0).otherwise(F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")) / letters)


def looks_like_heading(c: Column) -> Column:
    return (F.length(F.trim(c)) < 100) & (uppercase_ratio(c) >= 0.72)


def text_hash(c: Column) -> Column:
    return F.sha2(squeeze(c).cast("binary"), 256)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("||", *parts).cast("binary"), 256)


def roman(c: Column) -> Column:
    """Value of a Roman numeral; null if there is another character."""
    value = F.create_map(*(F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv))
    digits = F.transform(F.filter(F.split(F.upper(c), ""), lambda x: x != ""), lambda x: F.element_at(value, x))
    total = F.aggregate(digits, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, x: F.struct((a["sum"] + x - F.when(a["last"] < x, 2 * a["last"]).otherwise(0)).alias("sum"), x.alias("last")))
    return F.when(F.upper(c).rlike("^[IVXLCDM]+$"), total["sum"])


def numbers(c: Column) -> Column:
    """The numbers in a name, for natural order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))


def strip_number(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s*\(?\d+(?:[-.]\d+)*[.)]*\s*", "")


def heading_stem(c: Column) -> Column:
    return F.replace(fold(strip_number(c)), F.lit(" "), F.lit(""))


def elided_prefix(c: Column) -> Column:
    """What stands before a mark of elision; null without one."""
    return F.when(c.rlike(r"…|\.\.\.|\bpe\b"), squeeze(F.regexp_replace(c, r"(?s)(…|\.\.\.|\bpe\b).*$", "")))


def artifacts(c: Column) -> Column:
    """Repaired copies of damaged characters."""
    out = F.regexp_replace(c, "[\u00AD\u200B-\u200F\u2060\uFEFF\uFFFD]", "")
    return F.replace(out, F.lit("\u00A0"), F.lit(" "))


def punctuation_spacing(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\s+([,.;:!?])", "$1"), r"([,;:!?])(\p{L})", "$1 $2")


def position_in(at: Column, start: Column, end: Column) -> Column:
    return F.when(end > start, (at - start) / (end - start))


def excerpt(c: Column, limit: int, position: Column, reach: int = 300) -> Column:
    """A window of limit characters about a relative position, from the next separator within reach."""
    free = F.greatest(F.length(c) - limit, F.lit(0))
    start = F.least(F.greatest(F.floor(F.coalesce(position, F.lit(0.0)) * F.length(c) - limit / 2), F.lit(0)), free).cast("int")
    skip = F.instr(F.substr(c, start + 1, F.lit(reach)), " ")
    start = F.when((start > 0) & (skip > 0), start + skip).otherwise(start)
    return F.when(F.length(c) <= limit, c).otherwise(F.trim(F.substr(c, start + 1, F.lit(limit))))


def lookup(c: Column, table: dict[str, str], fallback: str | None = None) -> Column:
    out = F.lit(fallback) if fallback is not None else c
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def probes(c: Column, least: int = 8) -> Column:
    """Clauses of a text, then the text, then its longest clause."""
    clauses = F.filter(F.transform(F.split(c, "[,;:.!?]+"), squeeze), lambda x: F.length(x) >= least)
    longest = F.array_sort(F.transform(clauses, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    tail = F.when(F.size(clauses) > 0, F.array(F.get(longest, F.lit(0))["x"])).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(clauses, F.array(squeeze(c)), tail))
