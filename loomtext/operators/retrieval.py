"""Lexical and vector retrieval: match predicates, branches and the candidate union."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import cosine, grams, jaccard, padded_grams


def escaped(term: str) -> str:
    return "".join(x if x.isalnum() or x == " " else "\\" + x for x in term)


def has_prefix(text: Column, term: str) -> Column:
    """A word of the folded text starts with the term; a term of several words is a substring."""
    return F.contains(text, F.lit(term)) if " " in term else F.concat(F.lit(" "), text).contains(" " + term)


def has_stem(text: Column, term: str) -> Column:
    """As has_prefix, but the word ends in letters."""
    return F.contains(text, F.lit(term)) if " " in term else text.rlike(rf"(^|\s){escaped(term)}\p{{L}}*($|\s)")


def any_prefix(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | has_prefix(text, t)
    return out


def all_prefixes(text: Column, segments: Sequence[str], longest: int = 8, most: int = 6) -> Column:
    """Some segment has all of its longest words in the text."""
    out = F.lit(False)
    for s in list(dict.fromkeys(segments))[:most]:
        picked = sorted(set(s.split()), key=lambda w: (-len(w), w))[:longest]
        if len(picked) >= 2:
            part = F.lit(True)
            for t in picked:
                part = part & has_prefix(text, t)
            out = out | part
    return out


def chains(words: Sequence[str], window: int = 6, stride: int = 4, most: int = 4, single: int = 8) -> list[list[str]]:
    """Windows of adjacent words; one chain if the segment is short."""
    if len(words) < 2:
        return []
    if len(words) <= single:
        return [list(words)]
    return [list(words[i : i + window]) for i in range(0, len(words) - 1, stride) if len(words[i : i + window]) >= 2][:most]


def adjacent(text: Column, chain: Sequence[str]) -> Column:
    """The chain's words stand next to each other, each as a word's beginning."""
    return text.rlike("(^| )" + r"[^ ]* ".join(map(escaped, chain)))


def phrase_match(text: Column, segments: Sequence[str], most: int = 16) -> Column:
    out = F.lit(False)
    for c in [c for s in segments for c in chains(s.split())][:most]:
        out = out | adjacent(text, c)
    return out


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    return sum((has_stem(text, t).cast("int") for t in dict.fromkeys(terms)), F.lit(0))


def exact_substring(rows: DataFrame, text: str, segments: Sequence[str], key: str, limit: int = 40) -> DataFrame:
    """Rows that hold a segment word for word, shortest first."""
    any_ = F.lit(False)
    for s in segments:
        any_ = any_ | F.contains(F.col(text), F.lit(s))
    return rows.filter(any_).orderBy(F.length(text), key).limit(limit)


def gated(rows: DataFrame, text: str, narrow: Sequence[str], wide: Sequence[str]) -> DataFrame:
    """Rows with a narrow term, or with a wide one if no row has a narrow one."""
    inner = rows.filter(any_prefix(F.col(text), narrow))
    return inner if narrow and not inner.isEmpty() else rows.filter(any_prefix(F.col(text), wide))


def cover_rank(text: Column, terms: Sequence[str]) -> Column:
    """Deterministic cover density: matched words per word between the first and the last match."""
    hit = lambda w: reduce(lambda a, t: a | F.startswith(w, F.lit(t)), terms, F.lit(False))
    at = F.filter(F.transform(F.split(text, " "), lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
    return F.when(F.size(at) == 0, 0.0).otherwise(F.size(at) / (F.array_max(at) - F.array_min(at) + 1))


def word_similarity(query: str, text: Column) -> Column:
    """The largest similarity of the query's padded trigrams with those of a run of words of the folded text, as long as the
    query or one word shorter or longer."""
    n = len(query.split())
    own = padded_grams(F.lit(query))
    w = F.split(text, " ")
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: jaccard(own, padded_grams(F.array_join(F.slice(w, i, F.lit(k)), " "))))
    return F.array_max(F.concat(*(runs(k) for k in {max(1, n - 1), n, n + 1})))


def all_terms(text: Column, terms: Sequence[str]) -> Column:
    """All terms are words of the folded text."""
    return reduce(lambda a, t: a & F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {t} "), dict.fromkeys(terms), F.lit(True))


def vector_neighbours(rows: DataFrame, key: str, vector: str, query: Sequence[float], k: int) -> DataFrame:
    """The k nearest by cosine to one query vector, ties to the smaller key."""
    score = cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))
    return rows.withColumn("score", score).filter("score is not null").orderBy(F.desc("score"), key).limit(k)


def rare_first(rows: DataFrame, key: str, items: str, often: DataFrame, share: float) -> DataFrame:
    """(key, g): of each row's set, rarest first, as many that any set which has `share` of it has one of them."""
    ranked = rows.select(key, F.size(items).alias("n"), F.explode(items).alias("g")).join(often, "g").groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("count", "g"))).alias("gs"))
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(share) - 1e-9) + 1
    return ranked.select(key, F.explode(F.slice("gs", 1, keep.cast("int"))).alias("x")).select(key, F.col("x.g").alias("g"))


def set_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(l, r, score) of sets (l, s) and (r, s) whose Jaccard similarity is at least `least`, by a join on their rarest
    items alone: a pair at `least` shares one among the rarest (1 - least) of each side's. A row's key names one set."""
    often = a.select(F.explode("s").alias("g")).unionAll(b.select(F.explode("s"))).groupBy("g").count()
    met = rare_first(a, "l", "s", often, least).join(rare_first(b, "r", "s", often, least), "g").select("l", "r").distinct()
    scored = met.join(a.select("l", F.col("s").alias("ls")), "l").join(b.select("r", F.col("s").alias("rs")), "r").withColumn("score", jaccard(F.col("ls"), F.col("rs")))
    return scored.filter(F.col("score") >= least).select("l", "r", "score")


def met_by_left(a: DataFrame, b: DataFrame, share: float) -> DataFrame:
    """Pairs (l, r) of which the right set (r, s) has one of the left set's (l, s) rarest items, of so many that any set with
    `share` of the left one has one. Only items that left sets have are counted and joined."""
    own = a.select(F.explode("s").alias("g")).distinct()
    often = b.select(F.explode("s").alias("g")).join(own, "g", "left_semi").groupBy("g").count()
    known = own.join(often, "g", "left").select("g", F.coalesce("count", F.lit(0)).alias("count"))
    return b.select("r", F.explode("s").alias("g")).join(rare_first(a, "l", "s", known, share), "g").select("l", "r").distinct()


# Trigrams of a left side that go to the workers as they are, cells of a matrix of them, and characters at a time.
LEFT_GRAMS, CELLS, CHARS = 1 << 22, 1 << 24, 1 << 19
#: A text whose trigrams are its words' padded ones: two spaces before each word and one behind, of more the grams are none.
PADDED = lambda c: F.concat(F.lit("  "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "   "), F.lit(" "))


def distinct_grams(texts: Sequence[str], padded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, row, which): the distinct trigrams of all texts, sorted, and each text's distinct ones as places in them."""
    at = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    inside = row[:-2] == row[2:]
    if padded:
        inside &= (at[1:-1] != 32) | (at[2:] != 32)
    codes, which = np.unique((at[:-2] << 42 | at[1:-1] << 21 | at[2:])[inside], return_inverse=True)
    pairs = np.unique(row[:-2][inside] * max(1, len(codes)) + which)
    return codes, pairs // max(1, len(codes)), pairs % max(1, len(codes))


def left_blocks(left: DataFrame, padded: bool) -> list | None:
    """[(keys, codes, row, which)] of (l, text), in blocks of which texts by trigrams is at most CELLS, unless one text has
    more; null if there are more than LEFT_GRAMS in all."""
    out, held, grams_, all_ = [], [], 0, 0
    for x in left.toLocalIterator():
        n = max(0, len(x["text"]) - 2)
        all_ += n
        if all_ > LEFT_GRAMS:
            return None
        if held and (len(held) + 1) * (grams_ + n) > CELLS:
            out.append(held)
            held, grams_ = [], 0
        held.append(x)
        grams_ += n
    return [([x["l"] for x in b], *distinct_grams([x["text"] for x in b], padded)) for b in [*out, held] if b]


def shared_grams(left: DataFrame, right: DataFrame, padded: bool, least: float, of_both: bool) -> DataFrame | None:
    """(l, r, n, m, c) of texts (l, text) and (r, text): their numbers of distinct trigrams and how many are in both, where
    c / (n + m), or c / (n + m - c) unless of_both, is at least `least`. Right texts are counted where they lie, against
    matrices of the left ones; no pair, gram or text is shuffled. Null if the left side is too large for that."""
    blocks = left_blocks(left.filter("text is not null"), padded)
    if blocks is None:
        return None
    share = least if of_both else least / (1 + least)  # of n + m that must be in both

    def met(keys, own, own_row, own_which, codes, row, which, lines, m):
        n = np.bincount(own_row, minlength=len(keys))
        have = np.flatnonzero(n)
        if not len(have) or not len(codes):
            return
        place = np.minimum(np.searchsorted(own, codes), len(own) - 1)
        known = own[place] == codes
        yes = known[which]
        row, which = row[yes], place[which[yes]]
        enough = np.bincount(row, minlength=lines) + 1e-6 >= share * (n[have].min() + m)
        yes = enough[row]
        row, which = row[yes], which[yes]
        kept, row = np.unique(row, return_inverse=True)
        theirs = np.zeros((len(own), len(keys)), dtype=np.float32)
        theirs[own_which, own_row] = 1
        step = max(1, (CELLS >> 2) // len(own))
        for k in range(0, len(kept), step):
            a, b = np.searchsorted(row, [k, k + step])
            ours = np.zeros((min(step, len(kept) - k), len(own)), dtype=np.float32)
            ours[row[a:b] - k, which[a:b]] = 1
            c = (ours @ theirs).astype(np.int64)
            both = n[None, :] + m[kept[k : k + step]][:, None]
            x, y = np.nonzero((c > 0) & (c / np.maximum(both if of_both else both - c, 1) >= least))
            for i, j in zip(x, y):
                yield keys[j], kept[k + i], n[j], m[kept[k + i]], c[i, j]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            size = part["text"].str.len().to_numpy()
            cut = np.flatnonzero(np.diff(np.cumsum(size) // CHARS)) + 1
            found = []
            for p in np.split(np.arange(len(part)), cut):
                texts = part["text"].iloc[p].tolist()
                codes, row, which = distinct_grams(texts, padded)
                m = np.bincount(row, minlength=len(texts))
                for block in blocks:
                    found += [(key, part["r"].iloc[p[i]], n, m_, c) for key, i, n, m_, c in met(*block, codes, row, which, len(texts), m)]
            if found:
                yield pd.DataFrame(found, columns=["l", "r", "n", "m", "c"])

    kind = lambda rows, c: rows.schema[c].dataType.simpleString()
    return right.filter("text is not null").select("r", "text").mapInPandas(run, f"l {kind(left, 'l')}, r {kind(right, 'r')}, n long, m long, c long")


def trigram_best(left: DataFrame, right: DataFrame, left_key: str, left_text: str, right_key: str, right_text: str, least: float = 0.3) -> DataFrame:
    """Pairs whose padded trigrams have a Jaccard similarity of at least `least`, for a left side that is the smaller one."""
    counted = shared_grams(left.select(F.col(left_key).alias("l"), PADDED(F.col(left_text)).alias("text")), right.select(F.col(right_key).alias("r"), PADDED(F.col(right_text)).alias("text")), True, least, False)
    if counted is not None:
        return counted.select("l", "r", (F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("score"))
    a = left.select(F.col(left_key).alias("l"), padded_grams(F.col(left_text)).alias("s")).filter(F.size("s") > 0)
    b = right.select(F.col(right_key).alias("r"), padded_grams(F.col(right_text)).alias("s"))
    both = met_by_left(a, b, least).join(a.select("l", F.col("s").alias("ls")), "l").join(b.select("r", F.col("s").alias("rs")), "r")
    return both.withColumn("score", jaccard(F.col("ls"), F.col("rs"))).filter(F.col("score") >= least).select("l", "r", "score")


def dice_pairs(left: DataFrame, right: DataFrame, least: float = 0.65, margin: float = 0.1) -> DataFrame:
    """(l, r, score, covered) of texts (l, text) and (r, text): Dice of their distinct trigrams and the share of the left
    one's that the right one has, for all pairs at `least` less `margin` or more. The right side's texts should be distinct.
    Of a left side too large to go to the workers, such a pair shares a known part of the left one's trigrams, so that its
    rarest ones find it."""
    low = least - margin
    out = ((2 * F.col("c") / (F.col("n") + F.col("m"))).alias("score"), (F.col("c") / F.col("n")).alias("covered"))
    counted = shared_grams(left.select("l", "text"), right.select("r", "text"), False, low / 2 - 1e-9, True)
    if counted is None:
        a = left.select("l", grams(F.col("text"), 3).alias("s")).filter(F.size("s") > 0)
        b = right.select("r", grams(F.col("text"), 3).alias("s"))
        met = met_by_left(a, b, low / (2 - low))
        both = met.join(a.select("l", F.col("s").alias("ls")), "l").join(b.select("r", F.col("s").alias("rs")), "r")
        counted = both.select("l", "r", F.size("ls").alias("n"), F.size("rs").alias("m"), F.size(F.array_intersect("ls", "rs")).alias("c"))
    return counted.select("l", "r", *out).filter(F.col("score") >= low)


def postings(rows: DataFrame, key: str, text: str, least: int = 5) -> DataFrame:
    """(token, key, positions) of the words with at least `least` letters."""
    return rows.select(key, F.posexplode(F.split(text, " ")).alias("p", "token")).filter(F.length("token") >= least).groupBy("token", key).agg(F.sort_array(F.collect_list("p")).alias("positions"))


def contained_in(needles: DataFrame, rows: DataFrame, needle_key: str, needle: str, key: str, text: str) -> DataFrame:
    """Rows that hold a needle, by a join on the needle's rarest word and a check of the whole needle."""
    words = rows.select(key, F.explode(F.array_distinct(F.split(text, " "))).alias("w"))
    counts = words.groupBy("w").count()
    own = needles.select(needle_key, needle, F.explode(F.array_distinct(F.split(needle, " "))).alias("w"))
    # the first and last word of a needle may be parts of words; inner words are whole
    rare = own.join(counts, "w").groupBy(needle_key).agg(F.min_by("w", F.struct("count", "w")).alias("w"))
    near = needles.join(rare, needle_key).join(words, "w").join(rows, key)
    return near.filter(F.contains(F.concat(F.lit(" "), F.col(text), F.lit(" ")), F.concat(F.lit(" "), F.col(needle), F.lit(" ")))).select(needle_key, key)


def candidates(branches: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """The bag union of branches with their name and base weight."""
    out = None
    for name, (rows, base) in branches.items():
        part = rows.withColumns({"branch": F.lit(name), "base": F.lit(base)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
