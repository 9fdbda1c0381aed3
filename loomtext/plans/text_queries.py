"""Queries over ordered passages: text functions, retrieval, ranking, ranges and alignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import align as A
from ..operators import audit as U
from ..operators import ranges as R
from ..operators import ranking as K
from ..operators import retrieval as Q
from .base import PASSAGES, SECTIONS, fold_sql, folded, hits_sql, prefix_sql, proximity_sql, query, stem_sql

TERMS, MUST, SHOULD, AVOID = ("ertion", "anat", "shed"), ("the",), ("ertion", "inea"), ("onshon",)
SEGMENTS = ("of the and", "the and is", "der die das", "de la que")
CORPUS = {"en": "mul", "de": "att", "fr": "tik", "es": "nrf"}
CORPUS_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CORPUS.items()) + " ELSE lang END"


def fold_passages(t):
    """Passages with their folded text, computed once a row."""
    return T.computed(t("passages"), folded=T.fold(F.col("text")))


@query("passage_explode", f"WITH {PASSAGES} SELECT doc_id, sort_order, text FROM passages")
def passage_explode(t):
    return t("passages").select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), "text")


@query("normalize_text", f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents")
def normalize_text(t):
    return t("documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("strip_marks", "SELECT doc_id, lower(strip_accents(text)) AS plain FROM documents")
def strip_marks(t):
    return t("documents").select("doc_id", T.strip_marks(F.col("text")).alias("plain"))


@query("latin_ratio", f"""WITH f AS (SELECT doc_id, list_filter(string_split({fold_sql('text')}, ' '), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: regexp_full_match(x, '[a-z-]+'))) / len(w) END, 6) AS ratio FROM f""")
def latin_ratio(t):
    return t("documents").select("doc_id", F.round(T.latin_ratio(F.col("text")), 6).alias("ratio"))


@query("content_tokens", f"""WITH w AS (SELECT doc_id, list_transform(string_split({fold_sql('text')}, ' '), lambda x: regexp_replace(x, '^-+|-+$', '', 'g')) AS w FROM documents),
k AS (SELECT doc_id, list_filter(w, lambda x: length(x) >= 3 AND regexp_full_match(x, '[a-z]+') AND x NOT IN ({', '.join(f"'{x}'" for x in T.STOPWORDS)})) AS w FROM w),
d AS (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM k)
SELECT doc_id, array_to_string(w[1:24], ' ') AS tokens FROM d""")
def content_tokens(t):
    return t("documents").select("doc_id", F.array_join(T.content_tokens(F.col("text")), " ").alias("tokens"))


@query("query_segments", r"""WITH p AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '(?:\r?\n)+|[.!?;؛।॥]+\s*'), lambda x: regexp_replace(x, '^[ \t‘’“”"''-]+|[ \t‘’“”"''-]+$', '', 'g')),
  lambda x: len(string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' ')) >= 2) AS s FROM documents)
SELECT doc_id, CAST(len(CASE WHEN len(s) > 0 THEN s WHEN trim(text) <> '' THEN [trim(text)] ELSE [] END) AS BIGINT) AS n, CASE WHEN len(s) > 0 THEN s[1] WHEN trim(text) <> '' THEN trim(text) END AS first FROM p""")
def query_segments(t):
    s = t("documents").select("doc_id", T.segments(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("first"))


@query("text_hash", r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_hash FROM documents")
def text_hash(t):
    return t("documents").select("doc_id", T.text_hash(F.col("text")).alias("text_hash"))


@query("heading_rule", rf"""WITH {PASSAGES}, r AS (SELECT doc_id, sort_order, text, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS l, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS u FROM passages)
SELECT doc_id, sort_order FROM r WHERE length(trim(text)) < 100 AND l > 0 AND u / l >= 0.72""")
def heading_rule(t):
    return t("passages").filter(T.looks_like_heading(F.col("text"))).select("doc_id", F.col("sort_order").cast("long").alias("sort_order"))


@query("html_to_text", r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</(p|div|h[1-6]|li|tr)\s*>|<br\s*/?>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS h FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS h FROM b)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM c""")
def html_to_text(t):
    return t("pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query("term_prefix_search", f"WITH {PASSAGES}, {folded()} SELECT doc_id, sort_order, CAST({hits_sql('folded', TERMS)} AS BIGINT) AS term_hits FROM f WHERE {' OR '.join(prefix_sql('folded', x) for x in TERMS)}")
def term_prefix_search(t):
    rows = fold_passages(t)
    return rows.filter(Q.any_prefix(F.col("folded"), TERMS)).select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), Q.term_hits(F.col("folded"), TERMS).cast("long").alias("term_hits"))


@query("quote_and_search", f"WITH {PASSAGES}, {folded()} SELECT doc_id, sort_order FROM f WHERE {' OR '.join('(' + ' AND '.join(prefix_sql('folded', w) for w in sorted(set(s.split()))) + ')' for s in SEGMENTS)}")
def quote_and_search(t):
    return fold_passages(t).filter(Q.all_prefixes(F.col("folded"), SEGMENTS)).select("doc_id", F.col("sort_order").cast("long").alias("sort_order"))


@query("phrase_adjacent_search", f"WITH {PASSAGES}, {folded()} SELECT doc_id, sort_order FROM f WHERE {' OR '.join(f"regexp_matches(folded, '(^| ){'[^ ]* '.join(s.split())}')" for s in SEGMENTS)}")
def phrase_adjacent_search(t):
    return fold_passages(t).filter(Q.phrase_match(F.col("folded"), SEGMENTS)).select("doc_id", F.col("sort_order").cast("long").alias("sort_order"))


@query("substring_exact_shortest", f"WITH d AS (SELECT doc_id, {fold_sql('text')} AS folded FROM documents) SELECT doc_id, CAST(length(folded) AS BIGINT) AS n FROM d WHERE contains(folded, 'of the') OR contains(folded, 'de la') ORDER BY length(folded), doc_id LIMIT 40")
def substring_exact_shortest(t):
    rows = t("documents").select("doc_id", T.fold(F.col("text")).alias("folded"))
    return Q.exact_substring(rows, "folded", ["of the", "de la"], "doc_id").select("doc_id", F.length("folded").cast("long").alias("n"))


@query("term_gate_relax", f"WITH d AS (SELECT doc_id, {fold_sql('text')} AS folded FROM documents) SELECT doc_id FROM d WHERE CASE WHEN (SELECT count(*) FROM d WHERE {prefix_sql('folded', 'qqqxx')}) > 0 THEN {prefix_sql('folded', 'qqqxx')} ELSE {prefix_sql('folded', 'inea')} END")
def term_gate_relax(t):
    return Q.gated(t("documents").select("doc_id", T.fold(F.col("text")).alias("folded")), "folded", ["qqqxx"], ["inea"]).select("doc_id")


_SCORE = f"""greatest(0.0, 0.18 + {hits_sql('folded', TERMS)} / 3 * 0.22 + least(1.0, {hits_sql('folded', MUST)} / 1 * 0.55 + {hits_sql('folded', SHOULD)} / 2 * 0.45) * 0.38
  + {proximity_sql('folded', MUST + SHOULD)} * 0.17 + least(1.0, {hits_sql('folded', TERMS)} / {len({*TERMS, *MUST, *SHOULD})}) * 0.16 - {hits_sql('folded', AVOID)} / 1 * 0.3)"""


def scored(rows):
    text = F.col("folded")
    return rows.withColumn("score", F.round(K.score(text, F.lit(0.18), TERMS, MUST, SHOULD, AVOID, hits=Q.term_hits(text, TERMS)), 6))


@query("weighted_score_topk", f"WITH {PASSAGES}, {folded()} SELECT doc_id, sort_order, round({_SCORE}, 6) AS score FROM f WHERE {' OR '.join(prefix_sql('folded', x) for x in TERMS)} ORDER BY score DESC, doc_id, sort_order LIMIT 100")
def weighted_score_topk(t):
    rows = scored(fold_passages(t).filter(Q.any_prefix(F.col("folded"), TERMS)))
    return rows.select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), "score").orderBy(F.desc("score"), "doc_id", "sort_order").limit(100)


_RANK = "CASE corpus WHEN 'mul' THEN 3 WHEN 'att' THEN 2 WHEN 'tik' THEN 1 ELSE 0 END"


@query("flagship_search", f"""WITH {PASSAGES}, {folded()}, c AS (SELECT doc_id, sort_order, {CORPUS_SQL} AS corpus, sha256(folded) AS h, round({_SCORE}, 6) AS score FROM f WHERE {' OR '.join(prefix_sql('folded', x) for x in TERMS)}),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY {_RANK} DESC, score DESC, doc_id, sort_order) AS n FROM c)
SELECT doc_id, sort_order, corpus, score FROM r WHERE n = 1 ORDER BY score DESC, doc_id, sort_order LIMIT 50""")
def flagship_search(t):
    rows = scored(fold_passages(t).filter(Q.any_prefix(F.col("folded"), TERMS))).withColumns({"corpus": T.lookup(F.col("lang"), CORPUS), "h": F.sha2(F.col("folded").cast("binary"), 256), "key": F.struct("doc_id", "sort_order")})
    best = K.dedup_by_hash(rows, "h", F.lit(False), F.col("corpus"), "score", "key")
    return best.select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), "corpus", "score").orderBy(F.desc("score"), "doc_id", "sort_order").limit(50)


@query("hash_dedup_prefer", f"""WITH r AS (SELECT d.doc_id, {CORPUS_SQL} AS corpus, row_number() OVER (PARTITION BY sha256(text) ORDER BY CAST(l.doc_id IS NOT NULL AS INTEGER) DESC, CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 WHEN 'fr' THEN 1 ELSE 0 END DESC, n_chars DESC, d.doc_id) AS n
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) SELECT doc_id, corpus FROM r WHERE n = 1""")
def hash_dedup_prefer(t):
    labelled = t("labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    rows = t("documents").join(labelled, "doc_id", "left").withColumns({"corpus": T.lookup(F.col("lang"), CORPUS), "h": F.sha2(F.col("text").cast("binary"), 256)})
    return K.dedup_by_hash(rows, "h", F.coalesce("labelled", F.lit(False)), F.col("corpus"), "n_chars", "doc_id").select("doc_id", "corpus")


@query("corpus_quote_bonus", f"""WITH {PASSAGES}, {folded()}, q AS (SELECT doc_id, sort_order, {CORPUS_SQL} AS corpus, folded, {' + '.join(f"CAST(contains(folded, '{s}') AS INTEGER)" for s in SEGMENTS)} + CASE WHEN contains(folded, '{SEGMENTS[0]}') THEN 0.5 ELSE 0 END AS exact,
least(1.0, ({' + '.join(f"CASE WHEN contains(folded, '{s}') THEN {len(s)} ELSE 0 END" for s in SEGMENTS)}) / length(folded)) AS density FROM f WHERE folded <> '')
SELECT doc_id, sort_order, round(CASE corpus WHEN 'mul' THEN 0.28 WHEN 'att' THEN 0.06 WHEN 'tik' THEN 0.03 ELSE 0 END + (0.45 + CASE corpus WHEN 'mul' THEN 0.80 WHEN 'att' THEN 0.20 WHEN 'tik' THEN 0.10 ELSE 0 END) * exact + 1.20 * density, 6) AS bonus FROM q WHERE exact > 0""")
def corpus_quote_bonus(t):
    text = F.col("folded")
    rows = fold_passages(t).filter("folded <> ''").withColumns({"corpus": T.lookup(F.col("lang"), CORPUS), "exact": K.exact_rank(text, SEGMENTS), "density": K.exact_density(text, SEGMENTS)}).filter("exact > 0")
    return rows.select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), F.round(K.bonus(F.col("corpus"), F.col("exact"), F.col("density")), 6).alias("bonus"))


@query("quote_segment_score", f"WITH {PASSAGES}, {folded()}, h AS (SELECT doc_id, sort_order, {', '.join(f'{hits_sql("folded", dict.fromkeys(s.split()))} / {len(set(s.split()))} AS h{i}' for i, s in enumerate(SEGMENTS))} FROM f) SELECT doc_id, sort_order, round(greatest(h0, h1, h2, h3) * 0.7 + (h0 + h1 + h2 + h3) / 4 * 0.3, 6) AS score FROM h")
def quote_segment_score(t):
    return fold_passages(t).select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), F.round(K.quote_score(F.col("folded"), [s.split() for s in SEGMENTS], TERMS), 6).alias("score"))


@query("jaccard_neardup_pairs", f"""WITH d AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split({fold_sql('text')}, ' '), lambda x: length(x) >= 5 AND x NOT IN ({', '.join(f"'{x}'" for x in K.NOT_CONTENT)})))) AS w FROM documents),
c AS (SELECT w, min(doc_id) AS doc_id, len(w) AS n FROM d GROUP BY w), e AS (SELECT doc_id, n, unnest(w) AS x FROM c)
SELECT a.doc_id AS a, b.doc_id AS b, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS jaccard FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= {K.NEAR}""")
def jaccard_neardup_pairs(t):
    """Documents whose sets of content words are alike; of documents with one set the first stands for all."""
    words = t("documents").select("doc_id", F.array_sort(K.content_words(F.col("text"))).alias("s"))
    sets = words.filter(F.size("s") > 0).groupBy("s").agg(F.min("doc_id").alias("doc_id"))
    pairs = Q.set_pairs(sets.select(F.col("doc_id").alias("l"), "s"), sets.select(F.col("doc_id").alias("r"), "s"), K.NEAR).filter("l < r")
    return pairs.select(F.col("l").alias("a"), F.col("r").alias("b"), F.round("score", 6).alias("jaccard"))


def _grams_sql(x: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - {n - 2}), lambda i: substring({x}, i, {n})))"


@query("trigram_similarity_topk", f"""WITH {PASSAGES}, l AS (SELECT DISTINCT text FROM passages), g AS (SELECT item_id, text, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: {_grams_sql("('  ' || w || ' ')", 3)}))) AS g FROM benchmark),
h AS (SELECT text, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: {_grams_sql("('  ' || w || ' ')", 3)}))) AS g FROM l),
x AS (SELECT item_id, len(g) AS n, unnest(g) AS g FROM g), y AS (SELECT text, len(g) AS m, unnest(g) AS g FROM h), s AS (SELECT item_id, y.text, count(*) / (any_value(n) + any_value(m) - count(*)) AS score FROM x JOIN y USING (g) GROUP BY item_id, y.text HAVING count(*) / (any_value(n) + any_value(m) - count(*)) >= 0.4),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, text) AS k FROM s) SELECT item_id, text, round(score, 6) AS score, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 5""")
def trigram_similarity_topk(t):
    """Each benchmark passage with the five most like lines of the documents, at 0.4 or more."""
    lines = t("passages").select("text").distinct()
    pairs = Q.trigram_best(t("benchmark"), lines, "item_id", "text", "text", "text", 0.4)
    best = Window.partitionBy("l").orderBy(F.desc("score"), "r")
    return pairs.withColumn("rank", F.row_number().over(best)).filter("rank <= 5").select(F.col("l").alias("item_id"), F.col("r").alias("text"), F.round("score", 6).alias("score"), "rank")


@query("dice_margin_match")
def dice_margin_match(t):
    """Each benchmark passage's line: whole texts, alike and covered enough, and clearly ahead of the next line."""
    pairs = Q.dice_pairs(t("benchmark").select(F.col("item_id").alias("l"), "text"), t("passages").select("text").distinct().select(F.col("text").alias("r"), "text"))
    return A.strict_best(pairs, "l", 0.65, 0.1).filter("covered >= 0.85").select(F.col("l").alias("item_id"), F.col("r").alias("text"), F.round("score", 6).alias("score"))


@query("vector_cosine_knn", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS score FROM embeddings, q)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 20""")
def vector_cosine_knn(t):
    one = t("embeddings").filter("vec_id = 0").select("embedding").first()
    return Q.vector_neighbours(t("embeddings"), "vec_id", "embedding", one[0] if one else [0.0], 20).select("vec_id", F.round("score", 6).alias("score"))


@query("inverted_postings", f"WITH {PASSAGES}, {folded()}, w AS (SELECT doc_id, unnest(string_split(folded, ' ')) AS token FROM f) SELECT token, count(DISTINCT doc_id) AS docs, count(*) AS n FROM w WHERE length(token) >= 5 GROUP BY token HAVING count(DISTINCT doc_id) >= 3")
def inverted_postings(t):
    rows = fold_passages(t).select("doc_id", F.explode(F.split("folded", " ")).alias("token")).filter(F.length("token") >= 5)
    per = rows.groupBy("token", "doc_id").count()  # one shuffle by token serves both counts
    return per.groupBy("token").agg(F.count("*").alias("docs"), F.sum("count").alias("n")).filter("docs >= 3")


@query("contained_passages", f"""WITH {PASSAGES}, n AS (SELECT item_id, {fold_sql('text')} AS needle FROM benchmark), d AS (SELECT doc_id, {fold_sql('text')} AS folded FROM documents)
SELECT DISTINCT item_id, doc_id FROM n JOIN d ON contains(' ' || folded || ' ', ' ' || needle || ' ')""")
def contained_passages(t):
    needles = T.computed(t("benchmark"), needle=T.fold(F.col("text"))).select("item_id", "needle").filter("needle <> ''")
    return Q.contained_in(needles, t("documents").select("doc_id", T.fold(F.col("text")).alias("folded")), "item_id", "needle", "doc_id", "folded").distinct()


@query("interval_point_join", f'WITH {PASSAGES}, {SECTIONS} SELECT p.doc_id, sort_order, id FROM passages p JOIN sections s ON p.doc_id = s.doc_id AND sort_order BETWEEN s."start" AND s."end"')
def interval_point_join(t):
    points = t("passages").select("doc_id", F.col("sort_order").cast("long").alias("sort_order"))
    return R.point_in_range(points, t("sections"), "doc_id", "sort_order").select("doc_id", "sort_order", "id")


@query("shortest_cover", f'''WITH {PASSAGES}, {SECTIONS}, r AS (SELECT p.doc_id, sort_order, id, row_number() OVER (PARTITION BY p.doc_id, sort_order ORDER BY s."end" - s."start", id) AS n FROM passages p JOIN sections s ON p.doc_id = s.doc_id AND sort_order BETWEEN s."start" AND s."end") SELECT doc_id, sort_order, id FROM r WHERE n = 1''')
def shortest_cover(t):
    points = t("passages").select("doc_id", F.col("sort_order").cast("long").alias("sort_order"))
    return R.shortest_range(points, t("sections"), "doc_id", "sort_order", "sort_order", "id").select("doc_id", "sort_order", "id")


@query("interval_overlap_union", f'WITH {SECTIONS} SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM sections a JOIN sections b ON a.doc_id = b.doc_id AND a."start" <= b."end" AND a."end" >= b."start" WHERE a.id < b.id AND NOT (a."start" = b."start" AND a."end" = b."end")')
def interval_overlap_union(t):
    met = R.overlaps(t("sections"), t("sections"), "doc_id").filter("a_id < b_id and not (a_start = b_start and a_end = b_end)")
    return met.select("a_id", "b_id").distinct()


@query("or_join_rewritten", f'''WITH {PASSAGES}, {SECTIONS}, x AS (SELECT id AS text_id, doc_id, CASE WHEN id % 2 = 0 THEN "start" END AS "start", CASE WHEN id % 2 = 0 THEN "end" END AS "end", CASE WHEN id % 2 = 1 THEN doc_id * 100000 + "start" END AS passage FROM sections)
SELECT DISTINCT p.doc_id * 100000 + p.sort_order AS passage, x.text_id FROM passages p JOIN x ON x.passage = p.doc_id * 100000 + p.sort_order OR (x.doc_id = p.doc_id AND p.sort_order BETWEEN x."start" AND x."end")''')
def or_join_rewritten(t):
    even = F.col("id") % 2 == 0
    texts = t("sections").select(F.col("id").alias("text_id"), "doc_id", F.when(even, F.col("start")).alias("start"), F.when(even, F.col("end")).alias("end"), F.when(~even, F.col("doc_id") * 100000 + F.col("start")).alias("passage"))
    points = t("passages").select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), (F.col("doc_id") * 100000 + F.col("sort_order")).alias("passage"))
    return R.by_passage_or_range(points, texts, "doc_id", "passage", "sort_order").select("passage", "text_id")


@query("smallest_ancestor", f'''WITH {SECTIONS}, r AS (SELECT s.id, a.id AS ancestor, row_number() OVER (PARTITION BY s.id ORDER BY a."end" - a."start", len(a.path) DESC, a.id) AS n FROM sections s JOIN sections a ON a.doc_id = s.doc_id AND a."start" <= s."start" AND a."end" >= s."end" AND a."end" - a."start" >= 3)
SELECT s.id, r.ancestor FROM sections s LEFT JOIN (SELECT * FROM r WHERE n = 1) r USING (id)''')
def smallest_ancestor(t):
    return R.smallest_ancestor(t("sections"), "doc_id", F.col("end") - F.col("start") >= 3)


@query("clip_overreach", f'''WITH {SECTIONS}, c AS (SELECT s.id, min(o."start") AS cut FROM sections s JOIN sections o ON o.doc_id = s.doc_id AND o."start" > s."start" AND o."start" <= s."end" AND NOT (len(s.path) <= len(o.path) AND o.path[1:len(s.path)] = s.path) GROUP BY s.id)
SELECT id, "start", coalesce(cut - 1, "end") AS "end", cut IS NOT NULL AS clipped FROM sections LEFT JOIN c USING (id)''')
def clip_overreach(t):
    return R.clip_overreach(t("sections"), "doc_id").select("id", "start", "end", "clipped")


@query("outline_layer", f'''WITH {SECTIONS}, b AS (SELECT s.id, c.id AS child, len(c.path) AS depth FROM sections s JOIN sections c ON c.doc_id = s.doc_id AND c."start" >= s."start" AND c."end" <= s."end" AND len(c.path) > len(s.path) AND c.path[1:len(s.path)] = s.path),
n AS (SELECT *, count(*) OVER (PARTITION BY id, depth) AS n FROM b), m AS (SELECT *, min(depth) OVER (PARTITION BY id) AS least FROM n WHERE n >= 2) SELECT id AS parent, child FROM m WHERE depth = least''')
def outline_layer(t):
    return R.outline(t("sections"), "doc_id").select("parent", "child")


@query("close_ranges_lead", f'''WITH {SECTIONS}, s AS (SELECT doc_id, id, "start" FROM sections WHERE title <> 'whole'), m AS (SELECT doc_id, n - 1 AS last FROM sizes)
SELECT id, "start", coalesce(lead("start") OVER (PARTITION BY s.doc_id ORDER BY "start") - 1, last) AS "end" FROM s LEFT JOIN m USING (doc_id)''')
def close_ranges_lead(t):
    last = t("documents").select("doc_id", (F.size(F.split("text", "\n")) - 1).cast("long").alias("last"))
    return R.close_ranges(t("sections").filter("title <> 'whole'").select("doc_id", "id", "start"), "doc_id", "start", last).select("id", "start", "end")


@query("gaps_islands", f'''WITH {PASSAGES}, v AS (SELECT doc_id, sort_order, length(text) % 2 AS v FROM passages WHERE contains(text, ',')), n AS (SELECT *, CAST(v IS DISTINCT FROM lag(v) OVER w OR sort_order <> lag(sort_order) OVER w + 1 OR lag(sort_order) OVER w IS NULL AS INTEGER) AS new FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY sort_order)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY sort_order) AS run FROM n) SELECT doc_id, min(sort_order) AS "start", max(sort_order) AS "end", count(*) AS n FROM r GROUP BY doc_id, run''')
def gaps_islands(t):
    rows = t("passages").select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), (F.length("text") % 2).alias("v"), F.contains("text", F.lit(",")).alias("c")).filter("c")
    return R.islands(rows, "doc_id", "sort_order", "v").select("doc_id", "start", "end", "n")


@query("merge_verse_blocks", f'''WITH {PASSAGES}, k AS (SELECT doc_id, sort_order, trim(text) AS text, length(text) < 60 AS j FROM passages WHERE trim(text) <> ''), n AS (SELECT *, CAST(NOT (j AND coalesce(lag(j) OVER (PARTITION BY doc_id ORDER BY sort_order), false)) AS INTEGER) AS new FROM k),
b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY sort_order) AS block FROM n) SELECT doc_id, CAST(block AS BIGINT) AS block, min(sort_order) AS "start", count(*) AS n, string_agg(text, chr(10) ORDER BY sort_order) AS text FROM b GROUP BY doc_id, block''')
def merge_verse_blocks(t):
    rows = t("passages").withColumn("sort_order", F.col("sort_order").cast("long"))
    return R.merge_blocks(rows, "doc_id", "sort_order", "sort_order", "text", F.length("text") < 60).select("doc_id", "block", "start", F.size("ids").cast("long").alias("n"), "text")


@query("numbered_in_group", f'''WITH {PASSAGES}, h AS (SELECT doc_id, sort_order, CAST(length(text) % 4 = 0 AS INTEGER) AS h FROM passages), g AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY sort_order) AS group_no FROM h)
SELECT doc_id, sort_order, CAST(group_no AS BIGINT) AS group_no, CAST(sum(1 - h) OVER (PARTITION BY doc_id, group_no ORDER BY sort_order) AS BIGINT) AS number FROM g''')
def numbered_in_group(t):
    rows = t("passages").select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), F.length("text").alias("n"))
    return R.numbered_in_group(rows, "doc_id", "sort_order", F.col("n") % 4 == 0).select("doc_id", "sort_order", "group_no", "number")


@query("dup_rank_window", "SELECT doc_id, row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id) AS occurrence, count(*) OVER (PARTITION BY lang, sha256(text)) AS occurrences FROM documents")
def dup_rank_window(t):
    rows = t("documents").select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return R.occurrence(rows, ["lang", "h"], "doc_id").select("doc_id", F.col("occurrence").cast("long").alias("occurrence"), "occurrences")


@query("fill_forward_tags", f'''WITH {PASSAGES}, a AS (SELECT doc_id, sort_order, CASE WHEN length(text) % 3 = 0 THEN length(text) END AS tag FROM passages), b AS (SELECT *, max(tag) OVER (PARTITION BY doc_id ORDER BY sort_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a),
c AS (SELECT *, CASE WHEN before IS NULL OR tag >= before THEN tag END AS ok FROM b) SELECT doc_id, sort_order, CAST(last_value(ok IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sort_order) AS BIGINT) AS filled FROM c''')
def fill_forward_tags(t):
    rows = t("passages").select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), F.when(F.length("text") % 3 == 0, F.length("text").cast("long")).alias("tag"))
    return R.fill_forward(rows, "doc_id", "sort_order", "tag").select("doc_id", "sort_order", "filled")


@query("range_scalar_agg", f'WITH {PASSAGES}, {SECTIONS} SELECT s.id, (SELECT CAST(sum(length(p.text)) AS BIGINT) FROM passages p WHERE p.doc_id = s.doc_id AND p.sort_order BETWEEN s."start" AND s."end") AS chars FROM sections s')
def range_scalar_agg(t):
    points = t("passages").select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), F.length("text").cast("long").alias("n"))
    found = R.point_in_range(points, t("sections"), "doc_id", "sort_order").groupBy("id").agg(F.sum("n").alias("chars"))
    return t("sections").select("id").join(found, "id", "left")


@query("ordered_concat_gap_count", """WITH c AS (SELECT conv_id, role, turn, text, max(turn) OVER (PARTITION BY conv_id) + 1 AS total FROM conversations)
SELECT conv_id, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, CAST(max(total) - count(DISTINCT turn) AS BIGINT) AS missing, CAST(round(100.0 * count(DISTINCT turn) / max(total)) AS INTEGER) AS percent FROM c GROUP BY conv_id, role""")
def ordered_concat_gap_count(t):
    rows = t("conversations").withColumn("total", F.max("turn").over(Window.partitionBy("conv_id")) + 1)
    return R.merge_by_source(rows, ["conv_id", "role"], F.col("total"), "turn")


@query("interior_median_baseline", f'''WITH {PASSAGES}, n AS (SELECT source, doc_id * 100000 + sort_order AS pos, length(text) AS v FROM passages WHERE length(text) > 0), i AS (SELECT source, v, lag(pos) OVER (PARTITION BY source ORDER BY pos) AS b, lead(pos) OVER (PARTITION BY source ORDER BY pos) AS a, pos FROM n)
SELECT source, count(*) AS n, CAST(median(v) AS DOUBLE) AS median FROM i WHERE b = pos - 1 AND a = pos + 1 GROUP BY source HAVING count(*) >= 20''')
def interior_median_baseline(t):
    rows = t("passages").select("source", "doc_id", (F.col("doc_id") * 100000 + F.col("sort_order")).alias("at"), F.length("text").alias("n_")).filter("n_ > 0")
    return U.interior_median(rows, "source", "at", F.col("n_"), within=("doc_id",))


@query("vocab_freq5", f"WITH {PASSAGES}, {folded()}, w AS (SELECT unnest(string_split(folded, ' ')) AS word FROM f) SELECT word, count(*) AS n FROM w WHERE length(word) >= 2 GROUP BY word HAVING count(*) >= 5")
def vocab_freq5(t):
    return U.vocabulary(t("passages"), T.fold(F.col("text")))


@query("adjacent_bigrams", f"""WITH {PASSAGES}, {folded()}, t AS (SELECT string_split(folded, ' ') AS w FROM f), p AS (SELECT unnest(list_zip(w[:-2], w[2:])) AS p FROM t WHERE len(w) > 1), b AS (SELECT p[1] AS a, p[2] AS b, count(*) AS pairs FROM p GROUP BY ALL HAVING count(*) >= 2),
v AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM t) GROUP BY word) SELECT a, b, pairs, n FROM b JOIN v ON a || b = word""")
def adjacent_bigrams(t):
    return U.joined_pairs(t("passages"), T.fold(F.col("text")))


@query("unicode_histogram", r"WITH c AS (SELECT unnest(regexp_extract_all(text, '[^\x20-\x7E\n]')) AS char FROM documents) SELECT char, count(*) AS n FROM c GROUP BY char")
def unicode_histogram(t):
    return U.character_histogram(t("documents"), F.col("text"))


@query("level_profile", f'''WITH {SECTIONS}, r AS (SELECT doc_id, len(path) AS level, "end" - "start" + 1 AS span, coalesce(lag("end") OVER (PARTITION BY doc_id, len(path) ORDER BY "start", "end") >= "start", false) AS o FROM sections)
SELECT doc_id, CAST(level AS BIGINT) AS level, count(*) AS n, CAST(median(span) AS DOUBLE) AS median_span, max(span) AS max_span, count(*) FILTER (o) AS overlaps FROM r GROUP BY doc_id, level''')
def level_profile(t):
    rows = t("sections").withColumn("group", F.struct("doc_id", F.size("path").cast("long").alias("level")))
    return U.level_profile(rows, "group", "start", "end").select("group.*", "n", "median_span", "max_span", "overlaps")


@query("align_monotone")
def align_monotone(t):
    """The lines of a document aligned to the lines of the document that follows it, by shared words."""
    lines = fold_passages(t).select("doc_id", "sort_order", F.array_distinct(F.filter(F.split("folded", " "), lambda w: F.length(w) >= 6)).alias("w"))
    items = lines.select(F.col("doc_id").alias("work"), F.col("sort_order").alias("item"), F.explode("w").alias("x"))
    spots = lines.select((F.col("doc_id") - 1).alias("work"), F.col("sort_order").alias("at"), F.explode("w").alias("x"))
    pairs = items.join(spots, ["work", "x"]).groupBy("work", "item", "at").agg(F.count("*").cast("double").alias("weight"))
    return A.align_monotone(pairs, "work")


@query("longest_chain")
def longest_chain(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("work"), F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("at"))
    return A.longest_nondecreasing(rows, "work")


@query("collapse_and_diversify")
def collapse_and_diversify(t):
    """Ranked candidates without neighbours, alike ones behind."""
    rows = scored(fold_passages(t).filter(Q.any_prefix(F.col("folded"), TERMS))).orderBy(F.desc("score"), "doc_id", "sort_order").limit(300)
    ranked = rows.withColumns({"rank": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "doc_id", "sort_order")), "section": F.col("doc_id").cast("string"), "family": K.source_family(F.col("source")), "content": K.content_words(F.col("text"))})
    kept = K.collapse_adjacent(ranked, "section", "sort_order", "rank")
    return K.diversify(kept, "rank", "content", "family").select("doc_id", "sort_order", "score", "position")


@query("rerank_blend", f"""WITH {PASSAGES}, {folded()}, c AS (SELECT doc_id, sort_order, round({_SCORE}, 6) AS score FROM f WHERE {stem_sql('folded', 'ertion')}), r AS (SELECT doc_id, max(quality) * 0.5 AS relevance FROM labels GROUP BY doc_id)
SELECT doc_id, sort_order, CASE WHEN relevance IS NOT NULL THEN round(score * 0.3 + relevance * 0.7, 4) ELSE score END AS blended FROM c LEFT JOIN r USING (doc_id)""")
def rerank_blend(t):
    rows = scored(fold_passages(t).filter(Q.has_stem(F.col("folded"), "ertion")))
    relevance = t("labels").groupBy("doc_id").agg((F.max("quality") * 0.5).alias("relevance"))
    return K.rerank_blend(rows, relevance, "doc_id", "score").select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), "blended")


@query("page_of_results", f"""WITH {PASSAGES}, {folded()}, c AS (SELECT doc_id, sort_order, CAST({hits_sql('folded', TERMS)} AS BIGINT) AS hits FROM f), r AS (SELECT *, row_number() OVER (ORDER BY hits DESC, doc_id, sort_order) AS rank FROM c) SELECT rank, doc_id, sort_order, hits FROM r WHERE rank BETWEEN 21 AND 30""")
def page_of_results(t):
    rows = fold_passages(t).select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), Q.term_hits(F.col("folded"), TERMS).cast("long").alias("hits"))
    return K.page(rows, [F.desc("hits"), "doc_id", "sort_order"], 3, 10).select(F.col("rank").cast("long").alias("rank"), "doc_id", "sort_order", "hits")


@query("neighbourhood_window", f"""WITH {PASSAGES}, {folded()}, h AS (SELECT doc_id, sort_order FROM f WHERE {stem_sql('folded', 'inea')}) SELECT DISTINCT p.doc_id, p.sort_order FROM passages p JOIN h ON p.doc_id = h.doc_id AND p.sort_order BETWEEN h.sort_order - 1 AND h.sort_order + 3""")
def neighbourhood_window(t):
    hit = fold_passages(t).filter(Q.has_stem(F.col("folded"), "inea")).select("doc_id", F.explode(F.sequence(F.col("sort_order") - 1, F.col("sort_order") + 3)).alias("sort_order")).distinct()
    return t("passages").select("doc_id", "sort_order").join(hit, ["doc_id", "sort_order"], "left_semi").select("doc_id", F.col("sort_order").cast("long").alias("sort_order"))
