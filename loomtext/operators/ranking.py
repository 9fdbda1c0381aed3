"""Scoring, deduplication, diversification and paging of candidates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, words
from .retrieval import has_stem

# Weights of the score, bonuses and thresholds.
WEIGHTS = {"keyword": 0.22, "concept": 0.38, "must": 0.55, "should": 0.45, "proximity": 0.17, "db_hits": 0.16, "avoid": 0.3}
BRANCHES = {"translation": 0.88, "exact": 0.50, "quote": 0.42, "phrase": 0.52, "term": 0.18, "vector": 0.05}
QUOTE_WEIGHTS = {"exact": 0.34, "quote": 0.34, "phrase": 0.18, "term": 0.18}
SEMANTIC_WEIGHT = 0.45
CORPUS_RANK = {"mul": 3, "att": 2, "tik": 1, "nrf": 0}
CORPUS_BONUS = {"mul": 0.28, "att": 0.06, "tik": 0.03, "nrf": 0.0}
QUOTE_BONUS, DENSITY_BONUS = 0.45, 1.20
QUOTE_CORPUS_BONUS = {"mul": 0.80, "att": 0.20, "tik": 0.10, "nrf": 0.0}
TITLE_BONUS, TITLE_BONUS_FULL = 0.70, 1.50
NEAR, NEAR_IN_FAMILY, APART = 0.42, 0.26, 2
NOT_CONTENT = "atha bhante bhagava bhikkhave hoti honti idha kho pana tasma tattha tena vutta vuccati eva evam iti santi ahosi".split()


def value_of(c: Column, table: dict[str, float], other: float = 0.0) -> Column:
    return reduce(lambda out, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(out), table.items(), F.lit(other))


def hit_score(text: Column, terms: Sequence[str]) -> Column:
    """Share of the distinct terms that the folded text has."""
    own = list(dict.fromkeys(t for t in terms if t))
    return sum((has_stem(text, t).cast("int") for t in own), F.lit(0)) / F.lit(len(own)) if own else F.lit(0.0)


def proximity(text: Column, terms: Sequence[str]) -> Column:
    own = [t for t in terms if t and " " not in t]
    if not own:
        return F.lit(0.0)
    hit = lambda w: reduce(lambda a, t: a | F.startswith(w, F.lit(t)), own, F.lit(False))
    at = F.filter(F.transform(F.split(text, " "), lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
    return F.when(F.size(at) < 2, 0.0).otherwise(1 / F.ln(F.array_max(at) - F.array_min(at) + 3))


def quote_score(text: Column, segments: Sequence[Sequence[str]], terms: Sequence[str]) -> Column:
    if not segments:
        return hit_score(text, terms)
    parts = [hit_score(text, s) for s in segments]
    best = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return best * 0.7 + sum(parts, F.lit(0.0)) / len(parts) * 0.3


def exact_rank(text: Column, segments: Sequence[str], least: int = 3) -> Column:
    own = [s for s in segments if len(s.split()) >= least]
    if not own:
        return F.lit(0.0)
    has = lambda s: F.contains(text, F.lit(s))
    return sum((has(s).cast("int") for s in own), F.lit(0)) + F.when(has(own[0]), 0.5).otherwise(0.0)


def exact_density(text: Column, segments: Sequence[str], least: int = 3) -> Column:
    own = [s for s in segments if len(s.split()) >= least]
    matched = sum((F.when(F.contains(text, F.lit(s)), len(s)).otherwise(0) for s in own), F.lit(0))
    return F.when(F.length(text) == 0, 0.0).otherwise(F.least(F.lit(1.0), matched / F.length(text)))


def score(text: Column, base: Column, hints=(), must=(), should=(), avoid=(), semantic: Column | None = None, semantic_weight: Column | float = 0.0, quote: Column | None = None, quote_weight: Column | float = 0.0, hits: Column | None = None) -> Column:
    """The weighted score, not below 0."""
    w = WEIGHTS
    concept = F.least(F.lit(1.0), (hit_score(text, must) if must else F.lit(1.0)) * w["must"] + hit_score(text, should) * w["should"])
    found = F.least(F.lit(1.0), (F.lit(0) if hits is None else hits) / max(1, len({*hints, *must, *should})))
    total = base + hit_score(text, hints) * w["keyword"] + concept * w["concept"] + proximity(text, [*must, *should]) * w["proximity"] + found * w["db_hits"]
    total = total + (F.lit(0.0) if semantic is None else semantic) * semantic_weight + (F.lit(0.0) if quote is None else quote) * quote_weight
    return F.greatest(F.lit(0.0), total - hit_score(text, avoid) * w["avoid"])


def title_bonus(path: Column, terms: Sequence[str], tails: Sequence[str], least: int = 6) -> Column:
    """For a path part that names a term, more if the part ends like a work's name."""
    own = [t.replace(" ", "") for t in terms if len(t) >= least]
    if not own:
        return F.lit(0.0)
    piece = lambda p: F.replace(fold(p), F.lit(" "), F.lit(""))
    named = lambda p: reduce(lambda a, t: a | F.contains(p, F.lit(t)), own, F.lit(False))
    ends = lambda p: reduce(lambda a, t: a | F.endswith(p, F.lit(t)), tails, F.lit(False))
    each = F.transform(path, lambda x: F.when(named(piece(x)), F.when(ends(piece(x)), TITLE_BONUS_FULL).otherwise(TITLE_BONUS)).otherwise(0.0))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def bonus(corpus: Column, exact: Column, density: Column) -> Column:
    quoted = F.when(exact > 0, (QUOTE_BONUS + value_of(corpus, QUOTE_CORPUS_BONUS)) * exact + DENSITY_BONUS * density).otherwise(0.0)
    return value_of(corpus, CORPUS_BONUS) + quoted


def match_reason(keyword: Column, concept: Column, semantic: Column) -> Column:
    return F.when(concept >= 0.75, "concept").when(keyword >= 0.35, "keyword").when(semantic > 0, "semantic").otherwise("threshold")


def dedup_by_hash(rows: DataFrame, text_hash: str, translated: Column, corpus: Column, score_: str, key: str) -> DataFrame:
    """The preferred row of each text: with a translation, then by corpus, then by score, then by key. One aggregation, so
    that the copies of a text meet as partial results only."""
    order = F.struct((-F.coalesce(translated, F.lit(False)).cast("int")).alias("a"), (-value_of(corpus, CORPUS_RANK)).alias("b"), (-F.col(score_)).alias("c"), F.col(key).alias("d"))
    return rows.groupBy(F.col(text_hash).alias("__h")).agg(F.min_by(F.struct(*rows.columns), order).alias("__r")).select("__r.*")


def above_or_all(rows: DataFrame, score_: str, least: float) -> DataFrame:
    """Rows at or above the threshold, or all if there are none, in one pass over a flag."""
    any_ = rows.agg(F.max(F.col(score_) >= least).alias("__any"))
    return rows.join(F.broadcast(any_)).filter((F.col(score_) >= least) | ~F.coalesce("__any", F.lit(False))).drop("__any")  # one row


def collapse_adjacent(rows: DataFrame, section: str, at: str, rank: str, distance: int = APART) -> DataFrame:
    """Rows but those within `distance` of a better kept one of their section; only kept rows block. Rows without a
    section or position stay. A section's candidates are a top list's, so a group is small."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        yes = []
        for x in pdf.sort_values(rank).itertuples():
            if all(abs(getattr(x, at) - k) > distance for k in kept):
                kept.append(getattr(x, at))
                yes.append(x.Index)
        return pdf.loc[yes]

    placed = F.col(section).isNotNull() & F.col(at).isNotNull()
    return rows.filter(placed).groupBy(section).applyInPandas(keep, rows.schema).unionByName(rows.filter(~placed))


def content_words(text: Column) -> Column:
    return F.array_distinct(F.filter(words(fold(text)), lambda w: (F.length(w) >= 5) & ~w.isin(NOT_CONTENT)))


def source_family(path: Column) -> Column:
    parts = F.filter(F.transform(F.split(path, "->"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.array_join(F.slice(parts, 1, 4), " -> ")


def diversify(rows: DataFrame, rank: str, words_: str, family: str, top: int = 400) -> DataFrame:
    """`position`: among the best `top` rows, those too like a better one go behind the others, in their order; all rows
    behind them keep theirs. rank numbers the rows from 1."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[set, str]] = []
        first, later = [], []
        for x in pdf.sort_values(rank).itertuples():
            own = set(getattr(x, words_))

            def like(other: set) -> float:
                return len(own & other) / len(own | other) if own and other else 0.0

            near = any((s := like(w)) >= NEAR or (f == getattr(x, family) and s >= NEAR_IN_FAMILY) for w, f in kept)
            (later if near else first).append(x.Index)
            if not near:
                kept.append((own, getattr(x, family)))
        out = pdf.loc[first + later].copy()
        out["position"] = range(1, len(out) + 1)
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", position int"
    head = rows.filter(F.col(rank) <= top).groupBy(F.lit("top")).applyInPandas(order, schema)
    return head.unionByName(rows.filter(F.col(rank) > top).withColumn("position", F.col(rank).cast("int")))


def rerank_blend(rows: DataFrame, relevance: DataFrame, key: str, score_: str) -> DataFrame:
    """0.3 of the score and 0.7 of the relevance where there is one; the others keep their order behind."""
    both = rows.join(relevance, key, "left")
    return both.withColumn("blended", F.when(F.col("relevance").isNotNull(), F.round(F.col(score_) * 0.3 + F.col("relevance") * 0.7, 4)).otherwise(F.col(score_)))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page with absolute ranks."""
    top = rows.orderBy(*order).limit(number * size)
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # number * size rows
    return ranked.filter(F.col("rank") > (number - 1) * size)


def keyset_page(rows: DataFrame, at: str, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """Newest first, from behind the cursor (at, key), one row more than the page to show that there is more."""
    cursor = F.struct(at, key) < F.struct(F.lit(after[0]).alias(at), F.lit(after[1]).alias(key)) if after else F.lit(True)
    return rows.filter(cursor).orderBy(F.desc(at), F.desc(key)).limit(size + 1)


# Words without content in a query, marks included.
FILLERS = set(
    "có của và với khi đang người ấy một các những là thì mà để cho đến từ trong ngoài trên dưới rằng nên sẽ đã bị được vào ra này đó kia "
    "thế nào gì sao thật rất hơn nữa con cái vị a an the of in on at to for and or is was were are be been who what when where how that "
    "this with from by as it he she they".split()
)
TRIMMED = ",.;:!?\"'“”‘’()[]"


def query_ladder(query: str, most: int = 4) -> list[str]:
    """Shorter and shorter forms of a query: without fillers, then its 3, 2 and 1 most repeated words."""
    given = query.split()
    bare = [w.strip(TRIMMED).lower() for w in given]
    content = [w for w, b in zip(given, bare) if b not in FILLERS]
    seen: dict[str, list] = {}
    for i, (w, b) in enumerate(zip(given, bare)):
        if b not in FILLERS and len(b) >= 2:
            seen.setdefault(b, [0, i, w.strip(TRIMMED)])[0] += 1
    ranked = [x[2] for x in sorted(seen.values(), key=lambda x: (-x[0], x[1]))]
    steps = ([" ".join(content)] if 0 < len(content) < len(given) else []) + [" ".join(ranked[:n]) for n in (3, 2, 1) if len(ranked) >= n]
    same = " ".join(query.lower().split())
    return list(dict.fromkeys(s for s in steps if s.lower() != same))[:most]


def first_step_with_rows(steps: Sequence[str], search) -> tuple[str, DataFrame] | None:
    for s in steps:
        found = search(s)
        if not found.isEmpty():
            return s, found
    return None


def random_sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows by a seeded hash of their key: the same ones on every run, wherever they lie."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def preceding(rows: DataFrame, points: DataFrame, key: str, at: str, reach: int = 140) -> DataFrame:
    """(point, at of the row before it, distance): the rows of its document within reach before each point, nearest first by
    `distance`. A join by buckets of `reach` positions, of which a point meets two."""
    b = F.floor(F.col(at) / reach)
    p = points.select("point", key, F.col(at).alias("__at"), F.explode(F.array(b, b - 1)).alias("__b"))
    met = p.join(rows.withColumn("__b", b), [key, "__b"]).filter((F.col(at) < F.col("__at")) & (F.col(at) >= F.col("__at") - reach))
    return met.withColumn("distance", F.col("__at") - F.col(at)).drop("__at", "__b")
