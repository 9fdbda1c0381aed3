"""Hybrid retrieval: six branches of candidates, one union, one score, one ranked list.

Every branch reads passages (doc_id, sort_order, folded, corpus, text_hash, ...) that are already narrowed to the wanted
documents, gives a bounded number of rows in a fixed order, and carries its base weights. The list is ranked by window and
expression operators; only the collapse of neighbours and the diversification, which are sequential by nature, run over the
bounded list in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import cosine
from . import query as Q
from . import ranking as K
from . import retrieval as R

# How a translation's match adds up, and the shares of texts and rows of an exact quotation.
TRANSLATION_RANK, TRANSLATION_LIKENESS, TRANSLATION_MOST = 1.8, 0.42, 0.62
EXACT_SEGMENTS, EXACT_ROWS = 4, 40
# Fixed value: groups of tasks whose first rows meet before those of all.
GROUPS = 16


def star(passages: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Candidates' columns: passages with their documents and, where they have one, their sections. Sizes decide the join."""
    return passages.join(documents, "doc_id").join(sections, "section_id", "left")


def first(rows: DataFrame, order: Sequence[Column | str], limit: int) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def branch(rows: DataFrame, name: str, quote: float = 0.0, semantic: float = 0.0) -> DataFrame:
    kept = {"branch": F.lit(name), "base": F.lit(K.BRANCHES[name]), "quote_weight": F.lit(quote), "semantic_weight": F.lit(semantic)}
    have = rows.columns
    return rows.withColumns(kept | {c: F.lit(0.0) for c in ("term_hits", "semantic", "strength") if c not in have})


def translated(passages: DataFrame, translations: DataFrame, terms: Sequence[str], query: str, limit: int) -> DataFrame:
    """Passages by their translations: (doc_id, sort_order, start, end, source, folded_translation). A translation of one
    passage has no range; one of a range counts at the passage that it begins with. All terms must be in it."""
    shape = F.col("start").isNull() & F.col("end").isNull() | (F.col("start") == F.col("sort_order"))
    text = F.col("folded_translation")
    rows = translations.filter(shape & R.all_terms(text, terms)) if terms else translations.limit(0)
    rows = rows.withColumns({"rank_": R.cover_rank(text, list(terms) or [""]), "likeness": R.word_similarity(query, text), "translation_scope": F.when(F.col("start").isNull(), "passage").otherwise("section")})
    rows = rows.withColumn("strength", F.least(F.lit(TRANSLATION_MOST), F.col("rank_") * TRANSLATION_RANK + F.col("likeness") * TRANSLATION_LIKENESS))
    met = rows.select("doc_id", "sort_order", "source", "translation_scope", "rank_", "likeness", "strength").withColumnRenamed("source", "translation_source").join(passages, ["doc_id", "sort_order"])
    return first(met, [F.desc("likeness"), F.desc("rank_"), "sort_order", "doc_id", "translation_source"], min(Q.TRANSLATION_ROWS, max(10, limit))).drop("rank_", "likeness")


def retrieve(passages: DataFrame, analysis: dict, limit: int, translations: DataFrame | None = None, vector: Sequence[float] | None = None, embedding: str = "embedding") -> DataFrame:
    """The union of all branches that the analysis calls for, with branch and weights. The passages are read once: a row goes
    to each branch that it fits, and each branch keeps its first rows by (key, sort_order, doc_id), of which tasks keep no
    more than the limit before they meet."""
    text = F.col("folded")
    plans: list[tuple[str, str, Column, Column, int, float, float]] = []  # branch, part, fits, key, limit, quote and semantic weight
    quotes = [s for s in analysis["segment_texts"] if len(s.split()) >= Q.QUOTE_LEAST]
    for i, s in enumerate(quotes[:EXACT_SEGMENTS]):
        plans.append(("exact", f"exact{i}", F.contains(text, F.lit(s)), F.length(text).cast("double"), EXACT_ROWS, K.QUOTE_WEIGHTS["exact"], 0.0))
    segments = [" ".join(t) for t in analysis["segment_terms"]]
    cover = lambda parts: -R.cover_rank(text, list(dict.fromkeys(w for s in parts for w in s.split())))
    if any(len(set(s.split())) >= 2 for s in segments):
        plans.append(("quote", "quote", R.all_prefixes(text, segments), cover(segments), limit, K.QUOTE_WEIGHTS["quote"], 0.0))
    phrases = [p for p in [*analysis["expanded"], *analysis["must"], *analysis["should"], *segments] if " " in p]
    if phrases:
        plans.append(("phrase", "phrase", R.phrase_match(text, phrases), cover(phrases), limit, K.QUOTE_WEIGHTS["phrase"], 0.0))
    keywords = Q.single_terms([*analysis["hints"], *analysis["must"], *analysis["should"]]) or Q.single_terms(analysis["query_terms"])
    if keywords:
        gate, hits = Q.single_terms([*analysis["must"], *analysis["stems"]]) or keywords, -R.term_hits(text, keywords).cast("double")
        plans.append(("term", "term", R.any_prefix(text, gate), hits, 2 * limit, K.QUOTE_WEIGHTS["term"], 0.0))
        if gate != keywords:
            plans.append(("term", "wide", R.any_prefix(text, keywords), hits, 2 * limit, K.QUOTE_WEIGHTS["term"], 0.0))
    if vector is not None and embedding in passages.columns:
        near = cosine(F.col(embedding), F.array(*(F.lit(float(x)) for x in vector)))
        plans.append(("vector", "vector", near.isNotNull(), -near, limit, 0.0, K.SEMANTIC_WEIGHT))
    out = passages.limit(0)
    weights = {"branch": "string", "part": "string", "key": "double", "most": "int", "base": "double", "quote_weight": "double", "semantic_weight": "double"}
    if plans:
        each = [F.when(fits, F.struct(F.lit(name).alias("branch"), F.lit(part).alias("part"), key.alias("key"), F.lit(most).alias("most"), F.lit(K.BRANCHES[name]).alias("base"), F.lit(q).alias("quote_weight"), F.lit(s).alias("semantic_weight"))) for name, part, fits, key, most, q, s in plans]
        rows = passages.withColumn("__b", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull()))).select(*passages.columns, "__b.*")
        best = lambda r, *by: r.withColumn("__n", F.row_number().over(Window.partitionBy("part", *by).orderBy("key", "sort_order", "doc_id"))).filter(F.col("__n") <= max(p[4] for p in plans))
        # what each task kept meets in groups of tasks first, so that no task reads what all have kept
        met = best(rows.withColumn("__g", F.spark_partition_id() % GROUPS), "__g").drop("__g", "__n")
        ranked_ = best(met).filter("__n <= most")
        narrow = ranked_.withColumn("__gate", F.max(F.col("part") == "term").over(Window.partitionBy("branch")))  # a bounded list by now
        out = narrow.filter((F.col("part") != "wide") | ~F.col("__gate")).drop("__n", "__gate")
    else:
        out = out.withColumns({c: F.lit(None).cast(kind) for c, kind in weights.items()})
    out = out.withColumns({"term_hits": F.when(F.col("branch") == "term", -F.col("key")).otherwise(0.0), "semantic": F.when(F.col("branch") == "vector", -F.col("key")).otherwise(0.0), "strength": F.lit(0.0)}).drop("part", "key", "most")
    if translations is None or analysis["is_pali_like"] or not analysis.get("translation_terms"):
        return out
    return branch(translated(passages, translations, analysis["translation_terms"], analysis["raw_query"].lower(), limit), "translation").unionByName(out, allowMissingColumns=True)


def scored(candidates: DataFrame, analysis: dict) -> DataFrame:
    """Candidates with keyword, concept and score."""
    text, must, should = F.col("folded"), analysis["must"], [*analysis["should"], *analysis["stems"]]
    hints, words = analysis["hints"] or analysis["query_terms"], [t for t in analysis["segment_terms"]]
    total = K.score(text, F.col("base"), hints, must, should, analysis["avoid"], F.col("semantic"), F.col("semantic_weight"), K.quote_score(text, words, hints) if words else None, F.col("quote_weight"), F.col("term_hits"))
    concept = F.least(F.lit(1.0), (K.hit_score(text, must) if must else F.lit(1.0)) * K.WEIGHTS["must"] + K.hit_score(text, should) * K.WEIGHTS["should"])
    return candidates.withColumns({"keyword": K.hit_score(text, hints), "concept": concept, "score": F.round(total + F.coalesce("strength", F.lit(0.0)), 4)})


def ranked(candidates: DataFrame, analysis: dict, least: float, reranked: Callable[[DataFrame], DataFrame] | None = None, window: int = 30) -> DataFrame:
    """Each text once, above the least score (or all if none is), bonuses added, best first by `rank`.

    reranked: from the best `window` rows to (doc_id, sort_order, relevance), where a provider is set."""
    have = candidates.columns
    rows = candidates if "translation_source" in have else candidates.withColumn("translation_source", F.lit(None).cast("string"))
    rows = K.above_or_all(scored(rows, analysis).withColumn("key", F.struct("doc_id", "sort_order", "branch")), "score", least)
    rows = K.dedup_by_hash(rows, "text_hash", F.col("translation_source").isNotNull(), F.col("corpus"), "score", "key")
    order = [F.desc("score"), "doc_id", "sort_order"]
    if reranked is not None:
        rows = K.rerank_blend(rows, reranked(rows.orderBy(*order).limit(window)), ["doc_id", "sort_order"], "score").withColumn("score", F.col("blended")).drop("blended", "relevance")
    quotes = [s for s in analysis["segment_texts"] if len(s.split()) >= Q.QUOTE_LEAST]
    text = F.col("folded")
    exact = K.exact_rank(text, quotes)
    named = K.title_bonus(F.split("source_path", "->"), [*analysis["must"], *analysis["should"]], ("suttam", "sutta", "suttantam", "suttanta")) if "source_path" in have else F.lit(0.0)
    bonus = K.bonus(F.col("corpus"), exact, K.exact_density(text, quotes)) + named
    reason = F.when(F.col("translation_source").isNotNull(), "translation").when(exact > 0, "quote").otherwise(K.match_reason(F.col("keyword"), F.col("concept"), F.col("semantic")))
    rows = rows.withColumns({"score": F.round(F.col("score") + bonus, 4), "reason": reason}).drop("key")
    # at most the branches' limits together: one task numbers them
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit("list")).orderBy(*order)))


def spread(ranked_: DataFrame, section: str = "section_id") -> DataFrame:
    """The list without neighbours of better rows, alike ones behind, with `position`."""
    rows = ranked_.withColumns({"family": K.source_family(F.col("source_path")), "content": K.content_words(F.col("text"))})
    kept = K.collapse_adjacent(rows, section, "sort_order", "rank")
    again = kept.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit("list")).orderBy("rank")))
    return K.diversify(again, "rank", "content", "family").drop("family", "content")


def direct_translation(candidates: DataFrame, words: int) -> bool:
    """Whether a pasted translation was found, which makes expansion and reranking needless."""
    return words >= Q.TRANSLATION_WORDS and not candidates.isEmpty()


def result_page(listed: DataFrame, number: int, size: int, internal: Sequence[str] = ("keyword", "concept", "base", "quote_weight", "semantic_weight", "semantic", "term_hits", "strength", "branch", "text_hash")) -> DataFrame:
    """One page by position, without the columns that ranking needed."""
    return listed.filter(F.col("position").between((number - 1) * size + 1, number * size)).drop(*internal)


def search_passages(passages: DataFrame, text: str, number: int = 1, size: int = 5, concepts: Sequence[Q.Concept] = (), translations: DataFrame | None = None, expand: Callable[[dict], dict | None] | None = None, least: float = 0.5, ladder: bool = True) -> tuple[str, DataFrame]:
    """(the query that was searched, its page). An expansion is asked only where a provider is set and no pasted translation
    was found. A first page without rows is searched again by shorter and shorter forms of the query, until one has some."""
    spark = passages.sparkSession
    analysis = Q.analysis_of(spark, text, concepts)
    asked = spark.createDataFrame([(text,)], "q string").select(Q.translation_terms(F.col("q")).alias("t")).first()["t"]
    analysis["translation_terms"] = list(asked["terms"])
    limit = Q.basket(size, analysis)
    pasted = translations is not None and not analysis["is_pali_like"] and direct_translation(translated(passages, translations, analysis["translation_terms"], text.lower(), limit), asked["n"])
    if expand is not None and not pasted:
        analysis = Q.merged(analysis, expand(analysis))
    page = result_page(spread(ranked(retrieve(passages, analysis, limit, translations), analysis, least)), number, size)
    if ladder and number == 1 and page.isEmpty():
        found = K.first_step_with_rows(K.query_ladder(text), lambda step: search_passages(passages, step, 1, size, concepts, translations, expand, least, False)[1])
        if found:
            return found
    return text, page
