"""Queries of the search pipeline: analysis, filters, branches, ranking and translations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import providers as P
from ..operators import query as A
from ..operators import ranking as K
from ..operators import retrieval as R
from ..operators import search as S
from .base import PASSAGES, SECTIONS, fold_sql, folded, hits_sql, prefix_sql, proximity_sql, query, stem_sql
from .text_queries import CORPUS, CORPUS_SQL, fold_passages

NAMES_ASKED = ("toi muon tim {}", "Cho tôi tìm bài kinh {}", "khái niệm {} là gì", "{} ở đâu", "hãy tìm kiếm noi ve {}", "các {} trong")
CONCEPTS = (
    A.Concept("one", "first", ("ertion", "the and"), pali=("Anat", "ōther"), must=("ertion",), avoid=("onshon",), phrases=("of the and",)),
    A.Concept("two", "second", ("and", "de la"), pali=("inea", "shed"), should=("sheda",)),
)
ANALYSIS = {
    "raw_query": "thing of ertion", "is_pali_like": False, "query_terms": ["ertion"], "segment_terms": [["the", "and", "ertion"], ["la", "que"]], "segment_texts": ["and the of", "de la que", "of the"],
    "hints": ["anat", "shed"], "must": ["ertion"], "should": ["inea"], "avoid": ["onshon"], "expanded": ["of the"], "stems": ["ertio"], "translation_terms": ["thing", "ertion"],
}
LIMIT, LEAST = 60, 0.5
ASKED_SQL = "replace([" + ", ".join(f"'{x}'" for x in NAMES_ASKED) + "][CAST(p_partkey % 6 AS INTEGER) + 1], '{}', p_name)"


def asked(t):
    return t("part").select("p_partkey", F.replace(F.get(F.array(*map(F.lit, NAMES_ASKED)), (F.col("p_partkey") % 6).cast("int")), F.lit("{}"), F.col("p_name")).alias("asked"))


def _canonical_sql(x: str) -> str:
    bare = rf"trim(regexp_replace(regexp_replace(lower(strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'd'))), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    cut = f"trim(regexp_replace({bare}, '^(?:{'|'.join(A.PREFIXES)})+', ''))"
    for p in A.SUFFIXES:
        cut = f"trim(regexp_replace({cut}, '{p}', ''))"
    return f"array_to_string(list_filter(string_split({cut}, ' '), lambda w: w <> '' AND w NOT IN ({', '.join(f"'{w}'" for w in A.FILLERS)})), ' ')"


@query("canonicalize_query", f"SELECT p_partkey, {_canonical_sql(ASKED_SQL)} AS clean FROM part")
def canonicalize_query(t):
    return asked(t).select("p_partkey", A.canonical(F.col("asked")).alias("clean"))


def _called(concept: A.Concept) -> str:
    return "(" + " OR ".join(f"contains(q, '{x}')" if " " in x else f"contains(' ' || q || ' ', ' {x} ')" for x in concept.triggers) + ")"


def _listed(field: str) -> str:
    parts = [f"CASE WHEN {_called(c)} THEN [{', '.join(repr(T_fold(x)) for x in getattr(c, field))}]::VARCHAR[] ELSE []::VARCHAR[] END" for c in CONCEPTS]
    return f"array_to_string(list_concat({', '.join(parts)}), '|')"


def T_fold(x: str) -> str:
    return x.lower().translate(str.maketrans("āīūō", "aiuō"))


@query("analyze_query", rf"""WITH s AS (SELECT item_id, text, regexp_replace(lower(strip_accents(replace(text, 'đ', 'd'))) || ' ' || {_canonical_sql('text')}, '\s', ' ', 'g') AS q, {_canonical_sql('text')} AS clean, lower(strip_accents(text)) AS plain FROM benchmark),
r AS (SELECT *, list_filter(string_split({fold_sql('text')}, ' '), lambda w: w <> '') AS w FROM s)
SELECT item_id, clean, CASE WHEN contains(plain, 'khai niem') OR contains(plain, 'dinh nghia') OR contains(plain, 'la gi') OR contains(plain, 'giai thich') THEN 'definition' ELSE 'search' END AS intent,
len(w) > 0 AND len(list_filter(w, lambda x: regexp_full_match(x, '[a-z-]+'))) / len(w) >= 0.5 AS pali_like, {_listed('must')} AS must, {_listed('avoid')} AS avoid, {_listed('pali')} AS hints FROM r""")
def analyze_query(t):
    a = A.analyze(t("benchmark"), "text", CONCEPTS)
    listed = lambda f: F.array_join(f"analysis.{f}", "|").alias(f)
    return a.select("item_id", F.col("analysis.clean_query").alias("clean"), "analysis.intent", F.col("analysis.is_pali_like").alias("pali_like"), listed("must"), listed("avoid"), listed("hints"))


@query("query_tokens", f"""SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({', '.join(f"'{w}'" for w in T.QUESTION_WORDS)})), ' ') AS tokens FROM benchmark""")
def query_tokens(t):
    return t("benchmark").select("item_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query("compound_stems", f"""WITH w AS (SELECT item_id, list_filter(string_split({fold_sql('text')}, ' '), lambda w: length(w) >= 9) AS w FROM benchmark), s AS (SELECT item_id, list_transform(w, lambda w: substring(w, 1, 7)) AS s FROM w)
SELECT item_id, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ' ') AS stems FROM s""")
def compound_stems(t):
    return t("benchmark").select("item_id", F.array_join(T.long_stems(T.words(T.fold(F.col("text")))), " ").alias("stems"))


@query("translation_words", r"""WITH w AS (SELECT item_id, list_transform(regexp_extract_all(text, '\p{L}+'), lambda x: lower(x)) AS w FROM benchmark), u AS (SELECT item_id, w, list_filter(w, lambda x, i: list_position(w, x) = i) AS u FROM w),
c AS (SELECT item_id, w, u, list_filter(u, lambda x: length(x) >= 3 AND x NOT IN (""" + ", ".join(f"'{w}'" for w in sorted(A.TRANSLATION_STOPWORDS)) + """)) AS c FROM u),
o AS (SELECT item_id, w, u, list_transform(list_sort(list_transform(c, lambda x, i: {'n': -length(x), 'i': i, 'w': x})), lambda s: s.w)[1:10] AS o FROM c)
SELECT item_id, CAST(len(w) AS INTEGER) AS n, array_to_string(CASE WHEN len(w) < 6 THEN list_filter(u, lambda x: length(x) >= 2) ELSE o END, ' ') AS terms FROM o""")
def translation_words(t):
    return t("benchmark").select("item_id", A.translation_terms(F.col("text")).alias("t")).select("item_id", "t.n", F.array_join("t.terms", " ").alias("terms"))


@query("scope_filter", f"SELECT doc_id FROM documents WHERE {CORPUS_SQL} IN ('mul', 'att') AND starts_with(lower(source), 's')")
def scope_filter(t):
    return t("documents").filter(A.in_scope(F.col("source"), T.lookup(F.col("lang"), CORPUS), A.corpora(["mul", "att", "none"]), A.pitaka("sutta"))).select("doc_id")


@query("candidate_star", f'''WITH {PASSAGES}, {SECTIONS}, p AS (SELECT doc_id, sort_order, length(text) AS n, doc_id * 100000 + CASE WHEN sort_order % 8 = 7 THEN NULL ELSE sort_order // 4 + 1 END AS section_id FROM passages WHERE contains(text, 'ertion'))
SELECT p.doc_id, p.sort_order, p.n, d.lang, s.title FROM p JOIN documents d ON p.doc_id = d.doc_id LEFT JOIN sections s ON s.id = p.section_id''')
def candidate_star(t):
    at = F.col("sort_order").cast("long")
    p = t("passages").filter(F.contains("text", F.lit("ertion"))).select("doc_id", at.alias("sort_order"), F.length("text").cast("long").alias("n"), (F.col("doc_id") * 100000 + F.when(at % 8 != 7, F.expr("sort_order div 4") + 1)).alias("section_id"))
    return S.star(p, t("documents").select("doc_id", "lang"), t("sections").select(F.col("id").alias("section_id"), "title")).select("doc_id", "sort_order", "n", "lang", "title")


def _cover_sql(x: str, terms) -> str:
    at = f"list_filter(list_transform(string_split({x}, ' '), lambda w, i: CASE WHEN {' OR '.join(f"starts_with(w, '{t}')" for t in terms)} THEN i END), lambda i: i IS NOT NULL)"
    return f"(CASE WHEN len({at}) = 0 THEN 0.0 ELSE len({at}) / (list_max({at}) - list_min({at}) + 1) END)"


def _padded_sql(x: str) -> str:
    grams = "list_transform(range(1, length('  ' || w || ' ') - 1), lambda i: substring('  ' || w || ' ', i, 3))"
    return f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: {grams})))"


def _likeness_sql(q: str, x: str) -> str:
    n, own = len(q.split()), _padded_sql(f"'{q}'")
    runs = [f"list_transform(range(1, greatest(len(string_split({x}, ' ')) - {k} + 1, 1) + 1), lambda i: array_to_string(string_split({x}, ' ')[i:i + {k - 1}], ' '))" for k in sorted({max(1, n - 1), n, n + 1})]
    g = _padded_sql("r")
    return f"list_max(list_transform(list_concat({', '.join(runs)}), lambda r: CASE WHEN len({g}) = 0 THEN 0.0 ELSE len(list_intersect({own}, {g})) / len(list_distinct(list_concat({own}, {g}))) END))"


TRANSLATIONS = f"""translations AS (SELECT doc_id, sort_order, NULL::BIGINT AS "start", NULL::BIGINT AS "end", 'lines' AS source, folded AS tr FROM f WHERE sort_order % 2 = 0
  UNION ALL SELECT f.doc_id, f.sort_order, f.sort_order, f.sort_order + 3, 'parts', folded FROM f WHERE sort_order % 4 = 1)"""


def translations(t):
    rows = fold_passages(t).select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), F.col("folded").alias("folded_translation"))
    none = F.lit(None).cast("long")
    lines = rows.filter("sort_order % 2 = 0").withColumns({"start": none, "end": none, "source": F.lit("lines")})
    return lines.unionByName(rows.filter("sort_order % 4 = 1").withColumns({"start": F.col("sort_order"), "end": F.col("sort_order") + 3, "source": F.lit("parts")}))


def searched(t):
    rows = fold_passages(t).filter("folded <> ''")
    return rows.select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), "text", "folded", T.lookup(F.col("lang"), CORPUS).alias("corpus"), F.sha2(F.col("folded").cast("binary"), 256).alias("text_hash"), F.col("source").alias("source_path"), F.col("doc_id").cast("string").alias("section_id"))


_TRANSLATED = f"""tr AS (SELECT t.doc_id, t.sort_order, t.source AS translation_source, {_cover_sql('tr', ANALYSIS['translation_terms'])} AS rank_, {_likeness_sql(ANALYSIS['raw_query'], 'tr')} AS likeness FROM translations t
  WHERE ("start" IS NULL OR "start" = sort_order) AND {' AND '.join(f"contains(' ' || tr || ' ', ' {w} ')" for w in ANALYSIS['translation_terms'])}),
tb AS (SELECT tr.*, least(0.62, rank_ * 1.8 + likeness * 0.42) AS strength, p.folded, p.corpus, p.h FROM tr JOIN p USING (doc_id, sort_order) ORDER BY likeness DESC, rank_ DESC, sort_order, doc_id, translation_source LIMIT {min(80, max(10, LIMIT))})"""
_PASSAGES = f"p AS (SELECT doc_id, sort_order, folded, {CORPUS_SQL} AS corpus, sha256(folded) AS h FROM f WHERE folded <> '')"


@query("translation_search", f"WITH {PASSAGES}, {folded()}, {_PASSAGES}, {TRANSLATIONS}, {_TRANSLATED} SELECT doc_id, sort_order, translation_source, round(strength, 6) AS strength FROM tb")
def translation_search(t):
    found = S.translated(searched(t), translations(t), ANALYSIS["translation_terms"], ANALYSIS["raw_query"], LIMIT)
    return found.select("doc_id", "sort_order", "translation_source", F.round("strength", 6).alias("strength"))


_QUOTES = [s for s in ANALYSIS["segment_texts"] if len(s.split()) >= 3]
_SEGMENTS = [" ".join(x) for x in ANALYSIS["segment_terms"]]
_PHRASES = [*ANALYSIS["expanded"], *_SEGMENTS]
_WORDS = lambda xs: list(dict.fromkeys(w for s in xs for w in s.split()))
_KEYS = sorted({*ANALYSIS["hints"], *ANALYSIS["must"], *ANALYSIS["should"]})
_SHOULD = [*ANALYSIS["should"], *ANALYSIS["stems"]]
_HIT = lambda terms: f"{hits_sql('folded', terms)} / {len(terms)}"
_CONCEPT = f"least(1.0, {_HIT(ANALYSIS['must'])} * 0.55 + {_HIT(_SHOULD)} * 0.45)"
_QUOTE = "(" + "greatest(" + ", ".join(_HIT(x) for x in ANALYSIS["segment_terms"]) + ") * 0.7 + (" + " + ".join(_HIT(x) for x in ANALYSIS["segment_terms"]) + f") / {len(_SEGMENTS)} * 0.3)"
_TOTAL = f"""round(greatest(0.0, base + {_HIT(ANALYSIS['hints'])} * 0.22 + {_CONCEPT} * 0.38 + {proximity_sql('folded', [*ANALYSIS['must'], *_SHOULD])} * 0.17
  + least(1.0, term_hits / {len({*ANALYSIS['hints'], *ANALYSIS['must'], *_SHOULD})}) * 0.16 + {_QUOTE} * quote_weight - {_HIT(ANALYSIS['avoid'])} * 0.3) + strength, 4)"""
_EXACT = "(" + " + ".join(f"CAST(contains(folded, '{s}') AS INTEGER)" for s in _QUOTES) + f" + CASE WHEN contains(folded, '{_QUOTES[0]}') THEN 0.5 ELSE 0 END)"
_DENSITY = "least(1.0, (" + " + ".join(f"CASE WHEN contains(folded, '{s}') THEN {len(s)} ELSE 0 END" for s in _QUOTES) + ") / length(folded))"
_ALL = "(" + " OR ".join("(" + " AND ".join(prefix_sql("folded", w) for w in sorted(set(s.split()))) + ")" for s in _SEGMENTS) + ")"
_ADJACENT = "(" + " OR ".join(f"regexp_matches(folded, '(^| ){'[^ ]* '.join(s.split())}')" for s in _PHRASES) + ")"
_GATE = sorted({*ANALYSIS["must"], *ANALYSIS["stems"]})
RANKED_SQL = f"""WITH {PASSAGES}, {folded()}, {_PASSAGES}, {TRANSLATIONS}, {_TRANSLATED}, c AS (
  SELECT doc_id, sort_order, folded, corpus, h, 'translation' AS branch, 0.88 AS base, 0.0 AS quote_weight, 0.0 AS term_hits, strength, translation_source FROM tb
  {' '.join(f"UNION ALL (SELECT doc_id, sort_order, folded, corpus, h, 'exact', 0.50, 0.34, 0, 0, NULL FROM p WHERE contains(folded, '{s}') ORDER BY length(folded), sort_order, doc_id LIMIT 40)" for s in _QUOTES)}
  UNION ALL (SELECT doc_id, sort_order, folded, corpus, h, 'quote', 0.42, 0.34, 0, 0, NULL FROM p WHERE {_ALL} ORDER BY {_cover_sql('folded', _WORDS(_SEGMENTS))} DESC, sort_order, doc_id LIMIT {LIMIT})
  UNION ALL (SELECT doc_id, sort_order, folded, corpus, h, 'phrase', 0.52, 0.18, 0, 0, NULL FROM p WHERE {_ADJACENT} ORDER BY {_cover_sql('folded', _WORDS(_PHRASES))} DESC, sort_order, doc_id LIMIT {LIMIT})
  UNION ALL (SELECT doc_id, sort_order, folded, corpus, h, 'term', 0.18, 0.18, {hits_sql('folded', _KEYS)} AS th, 0, NULL FROM p WHERE CASE WHEN (SELECT count(*) FROM p WHERE {' OR '.join(prefix_sql('folded', x) for x in _GATE)}) > 0 THEN {' OR '.join(prefix_sql('folded', x) for x in _GATE)} ELSE {' OR '.join(prefix_sql('folded', x) for x in _KEYS)} END ORDER BY th DESC, sort_order, doc_id LIMIT {2 * LIMIT})
), s AS (SELECT *, {_TOTAL} AS score FROM c), a AS (SELECT * FROM s WHERE score >= {LEAST} OR (SELECT max(score) FROM s) < {LEAST}),
d AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY CAST(translation_source IS NOT NULL AS INTEGER) DESC, CASE corpus WHEN 'mul' THEN 3 WHEN 'att' THEN 2 WHEN 'tik' THEN 1 ELSE 0 END DESC, score DESC, doc_id, sort_order, branch) AS n FROM a),
b AS (SELECT *, round(score + CASE corpus WHEN 'mul' THEN 0.28 WHEN 'att' THEN 0.06 WHEN 'tik' THEN 0.03 ELSE 0 END + CASE WHEN {_EXACT} > 0 THEN (0.45 + CASE corpus WHEN 'mul' THEN 0.80 WHEN 'att' THEN 0.20 WHEN 'tik' THEN 0.10 ELSE 0 END) * {_EXACT} + 1.20 * {_DENSITY} ELSE 0 END, 4) AS total FROM d WHERE n = 1)
SELECT doc_id, sort_order, branch, total AS score, CASE WHEN translation_source IS NOT NULL THEN 'translation' WHEN {_EXACT} > 0 THEN 'quote' WHEN {_CONCEPT} >= 0.75 THEN 'concept' WHEN {_HIT(ANALYSIS['hints'])} >= 0.35 THEN 'keyword' ELSE 'threshold' END AS reason FROM b"""


@query("ranked_candidates", RANKED_SQL)
def ranked_candidates(t):
    found = S.ranked(S.retrieve(searched(t).drop("source_path"), ANALYSIS, LIMIT, translations(t)), ANALYSIS, LEAST)
    return found.select("doc_id", "sort_order", "branch", "score", "reason")


@query("search_page")
def search_page(t):
    """The whole pipeline: branches, one list, neighbours collapsed, alike ones behind, the second page."""
    listed = S.spread(S.ranked(S.retrieve(searched(t), ANALYSIS, LIMIT, translations(t)), ANALYSIS, LEAST))
    return S.result_page(listed, 2, 10).select("doc_id", "sort_order", "score", "reason", "position")


@query("above_or_all", f"WITH {PASSAGES}, s AS (SELECT doc_id, sort_order, length(text) AS score FROM passages) SELECT doc_id, sort_order FROM s WHERE score >= 10000000 OR (SELECT max(score) FROM s) < 10000000")
def above_or_all(t):
    rows = t("passages").select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), F.length("text").alias("score"))
    return K.above_or_all(rows, "score", 10_000_000).select("doc_id", "sort_order")


@query("title_bonus", """SELECT p_partkey, CASE WHEN contains(replace(p_name, ' ', ''), 'almond') OR contains(replace(p_name, ' ', ''), 'antique') OR contains(replace(p_name, ' ', ''), 'part00') THEN CASE WHEN ends_with(replace(p_name, ' ', ''), '1') THEN 1.5 ELSE 0.7 END ELSE 0.0 END AS bonus FROM part""")
def title_bonus(t):
    return t("part").select("p_partkey", K.title_bonus(F.array(F.lit("x"), F.regexp_replace("p_name", "[#_]", "")), ["almond", "antique", "part00"], ["1"]).alias("bonus"))


@query("source_labels", f"""SELECT doc_id, CASE {CORPUS_SQL} WHEN 'mul' THEN 'Tipiṭaka Mūla' WHEN 'att' THEN 'Aṭṭhakathā' WHEN 'tik' THEN 'Ṭīkā' WHEN 'nrf' THEN 'Añña' ELSE {CORPUS_SQL} END || ' -> ' || CASE WHEN n_chars % 2 = 0 THEN source || ' -> part' ELSE 'own' END AS label FROM documents""")
def source_labels(t):
    noise = F.array(F.lit(" "), F.col("source"), F.lit("Nidānavaṇṇanā niṭṭhitā."), F.lit("vaggo samatto"), F.lit(" part "))
    section = F.when(F.col("n_chars") % 2 == 0, noise)
    return t("documents").select("doc_id", A.display_source(T.lookup(F.col("lang"), CORPUS), section, F.array(F.lit("own"))).alias("label"))


_TITLES = ("1. Mūlavaggo", "Kathāvatthu", "Evaṃ me sutaṃ.", "(paṭhamo bhāgo)", "Iti vuttaṃ hoti yathā ettha tattha vuttaṃ hoti iti kho pana evaṃ hoti yathā vuttanti. Seyyathidaṃ.", "2. Cakkavattisuttaṃ", "Nidānavaṇṇanā niṭṭhitā", "")
_KIND = ("heading", "plain", "noise", "hidden", "noise", "heading", "noise", "noise")


@query("title_kinds", f"SELECT p_partkey, [{', '.join(f"'{k}'" for k in _KIND)}][CAST(p_partkey % {len(_KIND)} AS INTEGER) + 1] AS kind FROM part")
def title_kinds(t):
    rows = t("part").select("p_partkey", F.get(F.array(*map(F.lit, _TITLES)), (F.col("p_partkey") % len(_TITLES)).cast("int")).alias("title"))
    title = F.col("title")
    return rows.select("p_partkey", F.when(A.source_noise(title), "noise").when(A.hidden_level(title), "hidden").when(A.heading_title(title), "heading").otherwise("plain").alias("kind"))


@query("paragraph_no", "SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN o_orderstatus END, ''), nullif(o_orderpriority, '1-URGENT'), '') AS no FROM orders")
def paragraph_no(t):
    k = F.col("o_orderkey") % 3
    return t("orders").select("o_orderkey", A.paragraph_no(F.when(k == 0, "").when(k == 1, F.col("o_orderstatus")), F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority"))).alias("no"))


@query("term_counts", f"""WITH w AS (SELECT item_id, string_split({fold_sql('text')}, ' ') AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM w) SELECT item_id, term, count(*) AS n, CAST(min(i) AS BIGINT) AS first FROM u WHERE length(term) >= 2 GROUP BY item_id, term""")
def term_counts(t):
    words = T.computed(t("benchmark"), folded=T.fold(F.col("text"))).select("item_id", F.posexplode(F.split("folded", " ")).alias("i", "term")).filter(F.length("term") >= 2)
    return words.groupBy("item_id", "term").agg(F.count("*").alias("n"), (F.min("i") + 1).cast("long").alias("first"))


@query("probe_clauses", r"""WITH c AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS whole, list_filter(list_transform(regexp_split_to_array(text, '[,;:.!?]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 8) AS c FROM benchmark)
SELECT item_id, whole, CAST(len(list_distinct(list_append(c, whole))) AS INTEGER) AS n FROM c""")
def probe_clauses(t):
    p = t("benchmark").select("item_id", T.squeeze(F.col("text")).alias("whole"), T.probes(F.col("text")).alias("p"))
    return p.select("item_id", "whole", F.size("p").alias("n"))


@query("read_through_cache", "WITH c AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) SELECT d.doc_id, CASE WHEN c.doc_id IS NOT NULL THEN 'cached ' || d.doc_id ELSE 'asked ' || d.lang END AS payload FROM documents d LEFT JOIN c USING (doc_id)")
def read_through_cache(t):
    cache = t("labels").filter("quality = 1").select("doc_id").distinct().withColumn("payload", F.concat(F.lit("cached "), F.col("doc_id")))
    ask = lambda texts: [f"asked {x}" for x in texts]
    return P.read_through(t("documents").select("doc_id", "lang"), cache, ["doc_id"], "lang", ask)[0].select("doc_id", "payload")


@query("resolve_source", "SELECT d.doc_id, CASE WHEN l.q = 1 THEN 'human' WHEN d.n_chars > 300 THEN 'machine' END AS text FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l USING (doc_id)")
def resolve_source(t):
    q = t("labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    rows = t("documents").join(q, "doc_id", "left")
    return rows.select("doc_id", P.resolve(F.when(F.col("q") == 1, "human").otherwise(" "), F.when(F.col("n_chars") > 300, "machine").otherwise("")).alias("text"))


@query("tolerant_json", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(event_id AS INTEGER) END AS id, list_sum(CASE WHEN event_id % 4 = 3 THEN NULL ELSE list_filter([event_id, 2, 3], lambda x: x <= 3) END)::BIGINT AS allowed FROM events")
def tolerant_json(t):
    k, body = F.col("event_id") % 4, F.concat(F.lit('{"id": '), F.col("event_id"), F.lit(', "ids": ['), F.col("event_id"), F.lit(", 2, 3]}"))
    answer = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), body, F.lit(" as asked"))).otherwise("no answer")
    rows = t("events").select("event_id", P.tolerant_json(answer, "id int, ids array<long>").alias("j"))
    kept = F.filter("j.ids", lambda x: F.size(P.allowed_only(F.array(x), F.array(*(F.lit(i).cast("long") for i in (1, 2, 3))))) > 0)
    return rows.select("event_id", "j.id", F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("allowed"))


@query("source_order", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 1 ELSE 3 END AS source_order FROM orders")
def source_order(t):
    r = P.Registry(**{"5-LOW": F.lower, "1-URGENT": F.upper})
    return r.ordered(t("orders"), "o_orderpriority").select("o_orderkey", "source_order")


@query("source_repairs", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN upper(o_orderpriority || 'x') WHEN '5-LOW' THEN lower(o_orderpriority || 'x') ELSE o_orderpriority || 'x' END AS text FROM orders")
def source_repairs(t):
    r = P.Registry(**{"5-LOW": F.lower, "1-URGENT": F.upper})
    return t("orders").select("o_orderkey", r.repair(F.col("o_orderpriority"), F.concat("o_orderpriority", F.lit("x"))).alias("text"))


@query("source_options", "SELECT * FROM (VALUES ('whole', 0, true), ('src0', 1, true), ('none', 2, false), ('ai', 3, true)) v(value, position, available)")
def source_options(t):
    return P.source_options(["whole", "src0", "none", "ai"], t("documents"), "source", "ai", {"whole": "src0"})


@query("preceding_rows", f"WITH {PASSAGES}, h AS (SELECT doc_id, sort_order FROM passages WHERE {stem_sql('lower(text)', 'inea')}) SELECT h.doc_id * 100000 + h.sort_order AS point, p.sort_order, h.sort_order - p.sort_order AS distance FROM h JOIN passages p ON p.doc_id = h.doc_id AND p.sort_order < h.sort_order AND p.sort_order >= h.sort_order - 5")
def preceding_rows(t):
    rows = t("passages").select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), "text")
    points = rows.filter(R.has_stem(F.lower("text"), "inea")).withColumn("point", F.col("doc_id") * 100000 + F.col("sort_order"))
    return K.preceding(rows.drop("text"), points, "doc_id", "sort_order", 5).select("point", "sort_order", "distance")


@query("random_sample")
def random_sample(t):
    return K.random_sample(t("orders"), 100, 7, "o_orderkey").select("o_orderkey")


@query("log_empty_results", "SELECT count(*) FILTER (WHERE coalesce(len(ids), 0) = 0) AS empty, count(*) AS n FROM (SELECT CASE WHEN event_type = 'click' THEN NULL WHEN value > 0 THEN [event_id] ELSE [] END AS ids FROM events)")
def log_empty_results(t):
    ids = F.when(F.col("event_type") == "click", F.lit(None).cast("array<long>")).when(F.col("value") > 0, F.array("event_id")).otherwise(F.array().cast("array<long>"))
    return t("events").select(ids.alias("ids")).agg(F.count_if(F.coalesce(F.size("ids"), F.lit(0)) == 0).alias("empty"), F.count("*").alias("n"))


@query("cache_keys", "SELECT doc_id, sha256(lang || '||' || source || '||' || 'v1') AS key FROM documents")
def cache_keys(t):
    return t("documents").select("doc_id", T.cache_key(F.col("lang"), F.col("source"), F.lit("v1")).alias("key"))


@query("centred_scores", "SELECT l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS c FROM lineitem")
def centred_scores(t):
    from ..functions.similarity import centred

    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(centred(F.col("l_quantity"), "l_orderkey"), 6).alias("c"))


@query("edit_ratio", "SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS ratio FROM part")
def edit_ratio(t):
    from ..functions.similarity import edit_ratio as ratio

    return t("part").select("p_partkey", F.round(ratio(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


@query("anchor_similarity", """WITH g AS (SELECT doc_id, lang, text, list_distinct(list_transform(range(1, greatest(length(text[1:80]) - 4, 1) + 1), lambda i: substring(text[1:80], i, 5))) AS a, list_distinct(list_transform(range(1, greatest(length(text[1:220]) - 4, 1) + 1), lambda i: substring(text[1:220], i, 5))) AS b FROM documents WHERE length(text) >= 5)
SELECT x.doc_id, round(0.7 * 2 * len(list_intersect(x.a, y.a)) / (len(x.a) + len(y.a)) + 0.3 * 2 * len(list_intersect(x.b, y.b)) / (len(x.b) + len(y.b)), 6) AS score FROM g x JOIN g y ON y.doc_id = x.doc_id + 1""")
def anchor_similarity(t):
    from ..functions.similarity import ANCHORS, anchor_grams, anchor_likeness

    d = t("documents").filter(F.length("text") >= 5).select("doc_id", F.substring("text", 1, max(ANCHORS)).alias("text"))
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    pairs = T.computed(d.join(nxt, "doc_id"), a=anchor_grams(F.col("text")), b=anchor_grams(F.col("other")))
    return pairs.select("doc_id", F.round(anchor_likeness(F.col("a"), F.col("b")), 6).alias("score"))


@query("whole_page_window", f"WITH {PASSAGES}, r AS (SELECT doc_id, sort_order, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, sort_order) AS k FROM passages) SELECT doc_id, sort_order FROM r WHERE k BETWEEN 3 AND 4")
def whole_page_window(t):
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.length("text")), "sort_order")
    return t("passages").withColumn("k", F.row_number().over(w)).filter("k between 3 and 4").select("doc_id", F.col("sort_order").cast("long").alias("sort_order"))


@query("laddered_search")
def laddered_search(t):
    """A query that no passage holds as a whole is searched by its shorter forms."""
    return S.search_passages(searched(t), "zzqqx ertion", size=10)[1].select("doc_id", "sort_order", "score", "position")


@query("length_between", f"WITH {PASSAGES} SELECT doc_id, sort_order FROM passages WHERE length(text) BETWEEN 80 AND 200")
def length_between(t):
    return t("passages").filter(F.length("text").between(80, 200)).select("doc_id", F.col("sort_order").cast("long").alias("sort_order"))


@query("exact_range_join", f'''WITH {SECTIONS}, h AS (SELECT id AS tid, doc_id, "start" AS a, CASE WHEN "start" = "end" THEN NULL ELSE "end" END AS b FROM sections WHERE title <> 'whole'), r AS (SELECT h.tid, s.id, row_number() OVER (PARTITION BY h.tid ORDER BY len(s.path) DESC, s.title, s.id) AS n FROM h LEFT JOIN sections s ON s.doc_id = h.doc_id AND s."start" = h.a AND s."end" = coalesce(h.b, h.a)) SELECT tid, id FROM r WHERE n = 1''')
def exact_range_join(t):
    s = t("sections")
    h = s.filter("title <> 'whole'").select(F.col("id").alias("tid"), "doc_id", "start", F.when(F.col("start") != F.col("end"), F.col("end")).alias("b"))
    met = h.withColumn("end", F.coalesce("b", "start")).join(s, ["doc_id", "start", "end"], "left")
    w = Window.partitionBy("tid").orderBy(F.desc_nulls_last(F.size("path")), "title", "id")
    return met.withColumn("n", F.row_number().over(w)).filter("n = 1").select("tid", "id")


@query("sections_by_size", f'WITH {SECTIONS} SELECT "end" - "start" + 1 AS passages, count(*) AS sections FROM sections GROUP BY 1')
def sections_by_size(t):
    return t("sections").groupBy((F.col("end") - F.col("start") + 1).alias("passages")).agg(F.count("*").alias("sections"))


@query("open_scopes", "SELECT source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) x WHERE x.source = d.source) GROUP BY source")
def open_scopes(t):
    """What an import would still take: sources that no earlier batch has finished."""
    done = t("documents").join(t("labels").filter("toxic = 1"), "doc_id").select("source").distinct()
    return t("documents").join(done, "source", "left_anti").groupBy("source").agg(F.count("*").alias("n"))
