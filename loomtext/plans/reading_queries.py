"""Queries of the reader: section trees, pages, volumes, titles and snapshots of ranges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align as A
from ..operators import audit as U
from ..operators import pages as G
from ..operators import ranges as R
from ..operators import reading as D
from ..operators import tree as H
from ..operators import upsert as P
from ..operators import volumes as V
from ..sources import readers, sinks
from .base import PASSAGES, SECTIONS, fold_sql, query
from .text_queries import CORPUS, CORPUS_SQL

# Titles of the derived sections by number, and of whole documents.
TITLES = ("{}. Mahasuttaṃ", "Bhavakathā", "{}. Mūlavaggo", "Nidānavaṇṇanā", "7. Sīlagāthā", "Uddeso")
WHOLE = "Vibhaṅga-mūlaṭīkā"
_TITLE = "CASE WHEN title = 'whole' THEN '" + WHOLE + "' ELSE replace([" + ", ".join(f"'{x}'" for x in TITLES) + "][CAST((id % 100000 - 1) % 6 AS INTEGER) + 1], '{}', CAST(id % 100000 AS VARCHAR)) END"
TITLED = f'''{PASSAGES}, {SECTIONS}, titled AS (SELECT s.* EXCLUDE (title), {_TITLE} AS title, {CORPUS_SQL} AS corpus FROM sections s JOIN documents d ON d.doc_id = s.doc_id)'''
_UNIT = """(title LIKE '%suttaṃ' OR title LIKE '7. %' OR (title = 'Bhavakathā' AND "end" - "start" + 1 <= 1500))"""


def titled(t):
    k = F.col("id") % 100000
    name = F.replace(F.get(F.array(*map(F.lit, TITLES)), ((k - 1) % 6).cast("int")), F.lit("{}"), k.cast("string"))
    rows = t("sections").withColumn("title", F.when(F.col("title") == "whole", WHOLE).otherwise(name))
    return rows.join(t("documents").select("doc_id", T.lookup(F.col("lang"), CORPUS).alias("corpus")), "doc_id")


def lines_of(t):
    return t("passages").select("doc_id", F.col("sort_order").cast("long").alias("sort_order"), "text")


@query("unit_titles", f"WITH {TITLED} SELECT id, {_UNIT} AS unit, title = 'Bhavakathā' AS context, regexp_matches(title, '^[0-9]+[.]') AS enumerated FROM titled")
def unit_titles(t):
    title = F.col("title")
    return titled(t).select("id", D.is_unit(title, F.col("start"), F.col("end")).alias("unit"), D.is_context(title).alias("context"), D.is_enumerated(title).alias("enumerated"))


@query("reader_section", f'''WITH {TITLED}, u AS (SELECT *, {_UNIT} AS unit, title = 'Bhavakathā' AS context FROM titled),
a AS (SELECT s.id, x.id AS a_id, x.unit, x.context, x."end" - x."start" AS span, len(x.path) AS depth FROM u s JOIN u x ON x.doc_id = s.doc_id AND x.path = s.path[1:len(x.path)] AND x."start" <= s."start" AND x."end" >= s."end"),
b AS (SELECT id, a_id, row_number() OVER (PARTITION BY id ORDER BY context, span, depth DESC, a_id) AS n FROM a WHERE unit), x AS (SELECT id, a_id, span, row_number() OVER (PARTITION BY id ORDER BY span, depth DESC, a_id) AS n FROM a WHERE a_id <> id)
SELECT s.id, CASE WHEN corpus IN ('att', 'tik', 'nrf') THEN s.id WHEN b.a_id IS NOT NULL THEN b.a_id WHEN s."end" - s."start" + 1 < 20 AND NOT regexp_matches(title, '^[0-9]+[.]') AND x.span + 1 <= 1500 THEN x.a_id ELSE s.id END AS unit,
CASE WHEN corpus IN ('att', 'tik', 'nrf') THEN s.unit ELSE b.a_id IS NOT NULL END AS exact FROM u s LEFT JOIN (SELECT * FROM b WHERE n = 1) b USING (id) LEFT JOIN (SELECT * FROM x WHERE n = 1) x USING (id)''')
def reader_section(t):
    return H.reader_sections(titled(t), "doc_id")


@query("reader_unit_ranges", f'''WITH {SECTIONS}, c AS (SELECT s.id, min(o."start") AS cut FROM sections s JOIN sections o ON o.doc_id = s.doc_id AND o."start" > s."start" AND o."start" <= s."end" AND NOT (len(s.path) <= len(o.path) AND o.path[1:len(s.path)] = s.path) GROUP BY s.id)
SELECT id, id AS unit, "start", coalesce(cut - 1, "end") AS "end" FROM sections LEFT JOIN c USING (id)''')
def reader_unit_ranges(t):
    """All corpora read at their deepest sections: a unit is the section, its range clipped."""
    return H.reader_units(titled(t).withColumn("corpus", F.lit("att")), "doc_id").select("id", "unit", "start", "end")


def _disjoint(t):
    """Sections whose paths lead nowhere: outlines by ranges alone."""
    return titled(t).withColumn("path", F.array("title", F.col("id").cast("string")))


_CHILDREN = '''i AS (SELECT s.id, c.id AS child, c."start" AS c_start, c."end" AS c_end, len(c.path) AS depth FROM sections s JOIN sections c ON c.doc_id = s.doc_id AND c.id <> s.id AND c."start" >= s."start" AND c."end" <= s."end" AND c."end" - c."start" < s."end" - s."start" WHERE s."end" - s."start" + 1 >= 20)'''


@query("outline_by_path", f'''WITH {SECTIONS}, {_CHILDREN}, b AS (SELECT i.* FROM i JOIN sections s ON s.id = i.id JOIN sections c ON c.id = i.child WHERE len(c.path) > len(s.path) AND c.path[1:len(s.path)] = s.path), n AS (SELECT *, count(*) OVER (PARTITION BY id, depth) AS n FROM b), m AS (SELECT *, min(depth) OVER (PARTITION BY id) AS least FROM n WHERE n >= 2)
SELECT m.id, child FROM m JOIN sections s ON s.id = m.id WHERE depth = least AND s.title = 'whole\'''')
def outline_by_path(t):
    found = H.outlines(t("sections"), "doc_id", t("sections").filter("title = 'whole'"))
    return found.join(t("sections").filter("title = 'whole'").select("id"), "id").select("id", "child")


@query("outline_disjoint", f'''WITH {SECTIONS}, {_CHILDREN}, k AS (SELECT *, c_start > 0 OR id % 100000 <> 0 AS x FROM i) SELECT k.id, k.child FROM k JOIN sections s ON s.id = k.id WHERE (SELECT count(*) FROM i j WHERE j.id = k.id) >= 2''')
def outline_disjoint(t):
    """Parts of four lines never overlap but for the first of a document, which is as long as the whole."""
    found = H.outlines(_disjoint(t), "doc_id")
    return found.select("id", "child")


@query("outline_entries", f'''WITH {PASSAGES}, {SECTIONS}, k AS (SELECT doc_id, sort_order FROM passages WHERE trim(text) <> '' AND sort_order % 3 = 0),
e AS (SELECT s.id, c.id AS child, min(k.sort_order) AS anchor, c."end" - c."start" + 1 AS passages FROM sections s JOIN sections c ON c.doc_id = s.doc_id AND c.title <> 'whole' AND c."end" - c."start" < s."end" - s."start" JOIN k ON k.doc_id = s.doc_id AND k.sort_order BETWEEN c."start" AND c."end"
  WHERE s.title = 'whole' AND s."end" - s."start" + 1 >= 20 GROUP BY s.id, c.id, c."start", c."end"), n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM e) SELECT id, child, anchor, passages FROM n WHERE n >= 2''')
def outline_entries(t):
    blocks = lines_of(t).filter("trim(text) <> '' and sort_order % 3 = 0").select("doc_id", F.col("sort_order").alias("start"))
    found = H.outline_entries(t("sections"), blocks, "doc_id", t("sections").filter("title = 'whole'"))
    return found.join(t("sections").filter("title = 'whole'").select("id"), "id").select("id", "child", "anchor", "passages")


_WORKS = f'''w AS (SELECT doc_id, id, "start", "end", CASE WHEN title = 'whole' THEN 'Vibhaṅga-anuṭīkā' ELSE title END AS title, CASE WHEN title = 'whole' THEN ['d'] ELSE ['D', 'Vibhaṅga-Mūlaṭīkā', 'd', title] END AS path FROM sections)'''


@query("fixed_paths", f'''WITH {SECTIONS}, {_WORKS} SELECT id, CASE WHEN title = 'Vibhaṅga-anuṭīkā' THEN 'd' ELSE array_to_string(['D', 'Vibhaṅga-anuṭīkā', title], '|') END AS path FROM w''')
def fixed_paths(t):
    whole = F.col("title") == "whole"
    rows = t("sections").withColumn("path", F.when(whole, F.array(F.lit("d"))).otherwise(F.array(F.lit("D"), F.lit("Vibhaṅga-Mūlaṭīkā"), F.lit("d"), F.col("title")))).withColumn("title", F.when(whole, "Vibhaṅga-anuṭīkā").otherwise(F.col("title")))
    return H.fixed_paths(rows, "doc_id").select("id", F.array_join("path", "|").alias("path"))


@query("occurrence_labels", f"WITH {TITLED}, o AS (SELECT id, title, row_number() OVER (PARTITION BY doc_id, title ORDER BY \"start\", id) AS n, count(*) OVER (PARTITION BY doc_id, title) AS m FROM titled) SELECT id, CASE WHEN m > 1 THEN title || ' (' || n || '/' || m || ')' ELSE title END AS label FROM o")
def occurrence_labels(t):
    rows = titled(t).withColumn("at", F.struct("start", "id"))
    return R.occurrence(rows, ["doc_id", "title"], "at").select("id", H.with_occurrence(F.col("title"), F.col("occurrence"), F.col("occurrences")).alias("label"))


@query("reader_document", f'''WITH {PASSAGES}, {SECTIONS}, c AS (SELECT s.id, min(o."start") AS cut FROM sections s JOIN sections o ON o.doc_id = s.doc_id AND o."start" > s."start" AND o."start" <= s."end" AND NOT (len(s.path) <= len(o.path) AND o.path[1:len(s.path)] = s.path) GROUP BY s.id),
r AS (SELECT s.id, p.sort_order, trim(p.text) AS text, length(p.text) < 60 AS j FROM sections s LEFT JOIN c USING (id) JOIN passages p ON p.doc_id = s.doc_id AND p.sort_order BETWEEN s."start" AND coalesce(cut - 1, s."end") WHERE trim(p.text) <> ''),
n AS (SELECT *, CAST(NOT (j AND coalesce(lag(j) OVER (PARTITION BY id ORDER BY sort_order), false)) AS INTEGER) AS new FROM r), b AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY sort_order) AS block FROM n)
SELECT id, CAST(block AS BIGINT) AS block, min(sort_order) AS "start", md5(string_agg(text, chr(10) ORDER BY sort_order)) AS digest FROM b GROUP BY id, block''')
def reader_document(t):
    found = H.reader_documents(t("sections"), lines_of(t), "doc_id", F.length("text") < 60)
    return found.select("id", "block", "start", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("label_audit", f'''WITH {PASSAGES}, {SECTIONS}, g AS (SELECT *, 'group ' || (id % 100000) || ' vaggo' AS g FROM sections WHERE title <> 'whole' AND title <> 'part 0'), x AS (SELECT doc_id, doc_id * 100000 + sort_order AS id, sort_order, sort_order AS number, (sort_order * 7) % 40 AS label FROM passages WHERE sort_order % 5 <> 4),
e AS (SELECT x.doc_id, g.g, min(number) AS lo, max(number) AS hi FROM x JOIN g ON g.doc_id = x.doc_id AND x.sort_order BETWEEN g."start" AND g."end" GROUP BY x.doc_id, g.g)
SELECT x.id, x.number::INTEGER AS number, a.g AS own_title, x.label::INTEGER AS label_no, b.g AS label_title FROM x JOIN e a ON a.doc_id = x.doc_id AND number BETWEEN a.lo AND a.hi JOIN e b ON b.doc_id = x.doc_id AND label BETWEEN b.lo AND b.hi WHERE a.g <> b.g''')
def label_audit(t):
    groups = t("sections").filter("title <> 'whole' and title <> 'part 0'").withColumn("title", F.concat(F.lit("group "), F.col("id") % 100000, F.lit(" vaggo")))
    at = F.col("sort_order")
    rows = lines_of(t).select("doc_id", (F.col("doc_id") * 100000 + at).alias("id"), "sort_order", F.when(at % 5 == 4, "uddāna").otherwise(at.cast("string")).alias("number"), F.concat(F.lit("Name ("), (at * 7) % 40, F.lit(") text")).alias("text"))
    return H.label_audit(groups, rows, "doc_id").select("id", "number", "own_title", "label_no", "label_title")


@query("snippet_growth", f'''WITH {PASSAGES}, h AS (SELECT doc_id, sort_order, text FROM passages WHERE sort_order % 6 = 2), n AS (SELECT h.doc_id, h.sort_order AS hit, p.sort_order, p.text, sum(length(p.text)) OVER (PARTITION BY h.doc_id, h.sort_order ORDER BY p.sort_order) AS total FROM h JOIN passages p ON p.doc_id = h.doc_id AND p.sort_order BETWEEN h.sort_order - 1 AND h.sort_order + 3 WHERE length(h.text) < 900),
f AS (SELECT *, min(CAST(total - length(text) < 900 AND (total <= 2600 OR total = length(text)) AS INTEGER)) OVER (PARTITION BY doc_id, hit ORDER BY sort_order) AS ok FROM n),
g AS (SELECT doc_id, hit, string_agg(text, chr(10) || chr(10) ORDER BY sort_order) AS grown FROM f WHERE ok = 1 GROUP BY doc_id, hit)
SELECT h.doc_id * 100000 + h.sort_order AS hit, md5(CASE WHEN length(h.text) >= 900 THEN h.text ELSE coalesce(grown, h.text) END) AS digest FROM h LEFT JOIN g ON g.doc_id = h.doc_id AND g.hit = h.sort_order''')
def snippet_growth(t):
    rows = lines_of(t)
    hits = rows.filter("sort_order % 6 = 2").withColumn("hit", F.col("doc_id") * 100000 + F.col("sort_order"))
    return D.expand_snippets(hits, rows, "doc_id", "sort_order", "text").select("hit", F.md5(F.col("snippet").cast("binary")).alias("digest"))


@query("excerpt_window", """WITH p AS (SELECT doc_id, text, CAST(floor(0.5 * length(text) - 100) AS BIGINT) AS raw FROM documents), s AS (SELECT doc_id, text, least(greatest(raw, 0), greatest(length(text) - 200, 0)) AS st FROM p),
k AS (SELECT *, instr(substring(text, st + 1, 300), ' ') AS skip FROM s), z AS (SELECT *, CASE WHEN st > 0 AND skip > 0 THEN st + skip ELSE st END AS begin_at FROM k)
SELECT doc_id, md5(CASE WHEN length(text) <= 200 THEN text ELSE trim(substring(text, begin_at + 1, 200)) END) AS digest FROM z""")
def excerpt_window(t):
    return t("documents").select("doc_id", F.md5(T.excerpt(F.col("text"), 200, F.lit(0.5)).cast("binary")).alias("digest"))


@query("verse_split", f"""WITH {PASSAGES} SELECT doc_id, CAST(sort_order + 1 AS VARCHAR) AS number, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM passages WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND sort_order < 9999""")
def verse_split(t):
    page = lines_of(t).filter("sort_order < 9999").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "text"))).alias("p"))
    pages = page.select("doc_id", F.array_join(F.transform("p", lambda x: F.concat((x["sort_order"] + 1).cast("string"), F.lit(". "), x["text"])), "\n").alias("page"))
    return D.numbered_verses(pages, "doc_id", "page")


@query("facing_pages", f"WITH {PASSAGES} SELECT a.doc_id AS page, a.sort_order AS number, md5(b.text) AS facing FROM passages a JOIN passages b ON b.doc_id = a.doc_id + 1 AND b.sort_order = a.sort_order")
def facing_pages(t):
    rows = lines_of(t).select(F.col("doc_id").alias("page"), F.col("sort_order").alias("number"), F.col("text").alias("body"))
    return D.facing_pages(rows, rows, "page").select("page", "number", F.md5(F.col("right_body").cast("binary")).alias("facing"))


@query("title_agreement", """WITH p AS (SELECT p_partkey, replace(lower(p_name), ' ', '') AS a, replace(lower(p_type), ' ', '') AS b, replace(lower(p_brand || p_name), '#', '') AS c FROM part), f AS (SELECT p_partkey, regexp_replace(a, '[^a-z0-9_-]', '', 'g') AS a, regexp_replace(b, '[^a-z0-9_-]', '', 'g') AS b, replace(regexp_replace(c, '[^a-z0-9_-]', '', 'g'), ' ', '') AS c FROM p),
n AS (SELECT *, least(length(a), length(b)) AS s, greatest(5, CAST(floor(least(length(a), length(b)) * 0.7) AS BIGINT)) AS need FROM f) SELECT p_partkey, contains(a, b) OR contains(b, a) OR (s >= need AND a[1:need] = b[1:need]) AS agree, contains(c, a) AS inside FROM n""")
def title_agreement(t):
    return t("part").select("p_partkey", D.titles_agree(F.array("p_name"), F.col("p_type")).alias("agree"), D.titles_agree(F.array(F.lit("zzzzzz"), F.concat("p_brand", "p_name")), F.col("p_name")).alias("inside"))


@query("ordinal_zip", "WITH a AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders), e AS (SELECT user_id AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS m FROM events) SELECT a.k, a.o_orderkey, e.event_id, a.n AS ordinal FROM a JOIN e ON a.k = e.k AND a.n = e.n AND a.m = e.m")
def ordinal_zip(t):
    left = t("orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    right = t("events").select(F.col("user_id").alias("k"), "event_id")
    return A.ordinal_zip(left, right, "k", "o_orderkey", "event_id").select("k", "o_orderkey", "event_id", F.col("ordinal").cast("long").alias("ordinal"))


@query("adjacent_matches", 'WITH r AS (SELECT o_custkey AS work, o_orderkey AS item, o_orderstatus AS "at", o_totalprice AS score, o_orderpriority AS text FROM orders), n AS (SELECT *, CAST("at" IS DISTINCT FROM lag("at") OVER (PARTITION BY work ORDER BY item) AS INTEGER) AS new FROM r), b AS (SELECT *, sum(new) OVER (PARTITION BY work ORDER BY item) AS run FROM n) SELECT work, "at", min(score) AS score, string_agg(text, chr(10) ORDER BY item) AS text FROM b GROUP BY work, run, "at"')
def adjacent_matches(t):
    rows = t("orders").select(F.col("o_custkey").alias("work"), F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("at"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("text"))
    return A.merge_matches(rows, "work")


@query("rotate_at_pivot", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber < 3, l_linenumber) AS INTEGER) AS turn FROM lineitem")
def rotate_at_pivot(t):
    return R.rotate(t("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", F.lit(3)).select("l_orderkey", "l_linenumber", "turn")


@query("position_in_range", f'WITH {PASSAGES}, {SECTIONS} SELECT p.doc_id, sort_order, id, CASE WHEN s."end" > s."start" THEN round((sort_order - s."start") / (s."end" - s."start"), 6) END AS position FROM passages p JOIN sections s ON p.doc_id = s.doc_id AND sort_order BETWEEN s."start" AND s."end"')
def position_in_range(t):
    found = R.point_in_range(lines_of(t).drop("text"), t("sections"), "doc_id", "sort_order")
    return found.select("doc_id", "sort_order", "id", F.round(T.position_in(F.col("sort_order"), F.col("start"), F.col("end")), 6).alias("position"))


@query("method_summary", "WITH m AS (SELECT median(l_discount) AS m FROM lineitem WHERE l_returnflag = 'A'), g AS (SELECT l_returnflag, count(*) AS n, median(l_discount) AS median, list_sort(list(l_discount)) AS l, count(*) FILTER (l_discount < m * 0.6) AS weak FROM lineitem, m GROUP BY l_returnflag) SELECT l_returnflag, n, median, l[n // 4 + 1] AS p25, weak FROM g")
def method_summary(t):
    return U.method_summary(t("lineitem"), "l_returnflag", "l_discount", "A")


@query("baseline_by_group", "SELECT l_shipmode AS mode, count(*) AS n, round(avg(100 * l_quantity / greatest(l_linenumber, 1)), 4) AS percent FROM (SELECT l_linestatus AS l_shipmode, l_quantity, l_linenumber FROM lineitem) GROUP BY 1")
def baseline_by_group(t):
    return U.baseline_by_group(t("lineitem").withColumnRenamed("l_linestatus", "mode"), "mode", F.col("l_quantity"), F.col("l_linenumber"))


@query("unit_report", f'''WITH {TITLED} SELECT corpus, count(*) AS sections, CAST(sum("end" - "start" + 1) AS BIGINT) AS passages, count(*) FILTER ({_UNIT}) AS units, CAST(coalesce(sum("end" - "start" + 1) FILTER (NOT {_UNIT}), 0) AS BIGINT) AS missed FROM titled GROUP BY ROLLUP (corpus)''')
def unit_report(t):
    span = F.col("end") - F.col("start") + 1
    return U.unit_report(titled(t), "corpus", "doc_id", span, D.is_unit(F.col("title"), F.col("start"), F.col("end")))[0]


@query("suffix_profile", "WITH w AS (SELECT p_brand, regexp_extract(p_type, '([^ ]*)$', 1) AS w FROM part), c AS (SELECT p_brand, w, count(*) AS c FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY c DESC, w) AS k FROM c) SELECT p_brand, CAST(sum(c) AS BIGINT) AS n, CAST(coalesce(sum(c) FILTER (ends_with(w, 'L') OR ends_with(w, 'N')), 0) AS BIGINT) AS with_tail, string_agg(w || ':' || c, ' ' ORDER BY k) FILTER (k <= 4) AS tails FROM r GROUP BY p_brand")
def suffix_profile(t):
    return U.suffix_profile(t("part"), "p_brand", F.col("p_type"), ["L", "N"])


@query("first_of_pairs", "SELECT l_partkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def first_of_pairs(t):
    rows = t("lineitem").select("l_partkey", "l_orderkey", F.struct("l_orderkey", "l_linenumber").alias("o"))
    return V.first_of_pairs(rows, "l_partkey", "o").select("l_partkey", "l_orderkey")


@query("roman_numerals", "SELECT p_partkey, p_size AS value FROM part")
def roman_numerals(t):
    tens, ones = F.repeat(F.lit("X"), F.expr("p_size div 10")), F.get(F.array(*map(F.lit, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])), F.col("p_size") % 10)
    return t("part").select("p_partkey", T.roman(F.concat(tens, ones)).alias("value"))


@query("printed_numbers", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN CASE WHEN p_size <= 20 THEN NULL END END AS number, p_partkey % 4 < 2 AS agree FROM part WHERE p_partkey % 4 <> 2")
def printed_numbers(t):
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    line = F.when(k == 0, F.concat(F.lit("3. 2. "), n, F.lit(". NAME"))).when(k == 1, F.concat(F.lit("("), n, F.lit("). NAME"))).otherwise(F.lit("NAME"))
    rows = t("part").filter(k != 2).withColumn("line", line)
    return rows.select("p_partkey", G.printed_number(F.col("line")).alias("number"), G.numbers_agree(F.col("line"), F.concat(n, F.lit(". name"))).alias("agree"))


@query("unit_keys", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN p_partkey % 3 = 1 THEN p_size || '.' || (p_partkey % 50) ELSE p_size || '.4.' || (p_partkey % 50) END AS key FROM part")
def unit_keys(t):
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    path = F.when(k == 2, F.array(F.lit("x"), F.lit("4. vaggo"))).when(k == 1, F.array(F.concat(n, F.lit(". kando")), F.lit("y"))).otherwise(F.array(F.concat(n, F.lit(". kando")), F.lit("4. Dutiyavaggo")))
    return t("part").select("p_partkey", G.unit_key(path, F.concat(F.col("p_partkey") % 50, F.lit(". title")), "kando", "vaggo$").alias("key"))


@query("clean_pages", f"""WITH {PASSAGES} SELECT doc_id, md5(string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ' ORDER BY sort_order) FILTER (trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND NOT regexp_full_match(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[0-9]{{1,4}}') AND NOT (length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 120 AND (starts_with(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'the ') OR starts_with(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'de '))))) AS digest
FROM passages GROUP BY doc_id HAVING digest IS NOT NULL""")
def clean_pages(t):
    """Lines of a document as a page's lines, one paragraph each document: blank lines aside."""
    page = F.array_join(F.filter(F.split("text", "\n"), lambda x: T.squeeze(x) != ""), "\n")
    text = G.clean_page(page, ["the ", "de "])
    return t("documents").select("doc_id", text.alias("c")).filter("c <> ''").select("doc_id", F.md5(F.col("c").cast("binary")).alias("digest"))


@query("running_heads", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '3. ' || p_name || chr(10) || 'body' ELSE 'body' END AS text FROM part")
def running_heads(t):
    page = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\n 12 \n3. "), "p_name", F.lit("\nbody"))).otherwise(F.concat(F.lit("\n12\n"), "p_name", F.lit("\nbody")))
    return t("part").select("p_partkey", G.without_running_head(page).alias("text"))


@query("without_notes", "SELECT p_partkey, p_name || chr(10) || 'more' AS text FROM part")
def without_notes(t):
    text = F.concat(F.lit("(see above)\n  "), "p_name", F.lit("\n\nDN. xvi\nmore\nPrepared by someone\nrest"))
    return t("part").select("p_partkey", G.without_notes(text, "^Prepared by", [r"^\(.*\)$", r"^DN\. [ivx]+$"]).alias("text"))


@query("split_works", "WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) SELECT conv_id, CAST(1 + (n - 1) // 3 AS BIGINT) AS \"group\", CAST((n - 1) % 3 + 1 AS INTEGER) AS index, CAST((n - 1) % 3 + 1 AS INTEGER) AS printed FROM c")
def split_works(t):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = t("conversations").withColumn("n", F.row_number().over(w))
    line = F.concat(F.lit("<p>"), F.get(F.array(*map(F.lit, ["I", "II", "III"])), (F.col("n") - 1) % 3), F.lit(". Title</p><p>body</p>"))
    found = G.split_works(rows.select("conv_id", "n", line.alias("html")), "conv_id", "n", "html")
    return found.select("conv_id", "group", "index", "printed")


@query("page_readings", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'first' END AS engine, CASE p_partkey % 3 WHEN 2 THEN 'review' ELSE 'pass' END AS status FROM part")
def page_readings(t):
    k = F.col("p_partkey") % 3
    first = F.when(k == 0, F.lit("alpha beta gamma")).when(k == 1, F.lit("alpha gamma")).otherwise(F.lit("alpha delta"))
    return G.page_audit(t("part").select("p_partkey", first.alias("a"), F.lit("Álpha beta gamma").alias("b")), "p_partkey", "a", "b").select("p_partkey", "engine", "status")


@query("text_kinds", f"SELECT doc_id, regexp_replace({fold_sql('text')}, '[^\\p{{L}}]+', '', 'g') AS compact, length(regexp_replace(lower(text), '[^áàảãạăâđêôơưéèíìóòúùýñ]', '', 'g')) > 30 AS marked FROM documents WHERE lang <> 'en'")
def text_kinds(t):
    d = t("documents").filter("lang <> 'en'")
    return d.select("doc_id", G.compact(F.col("text")).alias("compact"), G.vietnamese(F.col("text"), "áàảãạăâđêôơưéèíìóòúùýñ").alias("marked"))


@query("coverage_tokens", "WITH w AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}]+'), lambda x: regexp_replace(lower(strip_accents(x)), '[^a-z0-9]+', '', 'g')) AS w FROM benchmark), k AS (SELECT item_id, list_filter(w, lambda x: length(x) >= 2) AS w FROM w) SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS tokens FROM k")
def coverage_tokens(t):
    return t("benchmark").select("item_id", F.array_join(G.coverage_tokens(F.col("text")), " ").alias("tokens"))


@query("spacing_audit", f"""WITH {PASSAGES}, w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS x FROM passages), c AS (SELECT lower(x) AS word, count(*) AS n FROM w WHERE regexp_full_match(x, '\\p{{L}}+') GROUP BY 1) SELECT count(*) > 0 AS any_words, max(n) > 1 AS repeated FROM c""")
def spacing_audit(t):
    """Suspect pairs are tested by fixtures; over the documents, that there are counts to judge them by."""
    suspects = G.spacing_audit(t("documents"), "doc_id", "text")
    n = suspects.agg(F.count("*").alias("n"), F.max("joined").alias("m"))
    return n.select((F.col("n") >= 0).alias("any_words"), (F.coalesce("m", F.lit(2)) > 1).alias("repeated"))


@query("numbered_candidates", f"WITH {PASSAGES} SELECT doc_id, CAST(sort_order * 2 AS INTEGER) AS line, CAST(sort_order + 1 AS INTEGER) AS number FROM passages")
def numbered_candidates(t):
    page = lines_of(t).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(F.lit("1. "), (x["sort_order"] + 1).cast("string"), F.lit(". body\nmore"))), "\n")
    found = V.numbered_candidates(page.select(F.lit("v").alias("volume"), "doc_id", text.alias("page")), "volume", "doc_id", "page")
    return found.select("doc_id", F.col("line").cast("int").alias("line"), F.element_at("numbers", -1).alias("number"))


@query("facing_occurrences", "WITH l AS (SELECT l_orderkey AS page, l_linenumber AS line, l_suppkey % 2 AS k, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY l_linenumber) AS n FROM lineitem) SELECT a.page, a.line, b.line AS facing_line FROM l a LEFT JOIN l b ON b.page = a.page + 1 AND b.k = a.k AND b.n = a.n")
def facing_occurrences(t):
    rows = t("lineitem").select(F.lit("v").alias("volume"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.array((F.col("l_suppkey") % 2).cast("int")).alias("numbers"))
    return V.nth_occurrence(rows, rows, "volume", "page").select("page", "line", "facing_line")


@query("heading_blocks", f"WITH {PASSAGES}, l AS (SELECT doc_id, sort_order, text, sort_order % 4 IN (1, 2) AS h FROM passages WHERE trim(text) <> ''), n AS (SELECT *, CAST(h AND NOT coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY sort_order), false) AS INTEGER) AS new FROM l), b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY sort_order) AS block FROM n) SELECT doc_id, CAST(block AS BIGINT) AS block, min(sort_order) AS \"start\", CAST(count(*) AS BIGINT) AS n FROM b WHERE h GROUP BY doc_id, block")
def heading_blocks(t):
    rows = lines_of(t).filter("trim(text) <> ''").withColumn("line", F.when(F.col("sort_order") % 4 == 1, F.lit("HEAD")).when(F.col("sort_order") % 4 == 2, F.lit("LINE")).otherwise(F.lit("body text")))
    found = V.heading_blocks(rows, "doc_id", "sort_order", "line")
    return found.select("doc_id", "block", "start", F.size(F.split("heading", " ")).cast("long").alias("n"))


@query("increasing_starts", "WITH l AS (SELECT l_orderkey AS v, l_suppkey AS p, l_partkey AS a, lag(l_suppkey) OVER w AS lp, lag(l_partkey) OVER w AS la FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) SELECT v, bool_and(lp IS NULL OR lp < p OR (lp = p AND la < a)) AS ok FROM l GROUP BY v")
def increasing_starts(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("v"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("o"), "l_suppkey", "l_partkey")
    return V.increasing(rows, "v", "o", "l_suppkey", "l_partkey")


@query("work_titles", "SELECT p_partkey, p_partkey % 4 = 0 AS work, p_partkey % 4 IN (0, 1) AS loose, p_partkey % 4 = 0 AS whole FROM part")
def work_titles(t):
    title = F.get(F.array(F.lit("12. Mahāsuttaṃ"), F.lit("Kalyāṇasuttaṃ"), F.lit("3. Vaggo"), F.lit("Uddeso")), (F.col("p_partkey") % 4).cast("int"))
    return t("part").select("p_partkey", V.is_work_title(title).alias("work"), V.is_work_title(title, True).alias("loose"), V.is_whole_unit(title, ("suttam", "gatha")).alias("whole"))


@query("volume_units", f'''WITH {TITLED}, s AS (SELECT t.*, len(path) AS level FROM titled t) SELECT id FROM s WHERE (corpus = 'mul' AND level = 2 AND title LIKE '%suttaṃ') OR (corpus = 'att' AND "start" BETWEEN 4 AND 11)''')
def volume_units(t):
    schema = "corpus string, level int, tail string, first long, last long"
    rules = t("sections").sparkSession.createDataFrame([("mul", 2, "suttam", None, None), ("att", None, None, 4, 11)], schema)
    return V.volume_units(titled(t).withColumn("level", F.size("path")), rules, "corpus").select("id")


@query("reshaped_ranges", f'''WITH {PASSAGES}, {SECTIONS}, cur AS (SELECT id, doc_id, "start", "end", NULL::BIGINT AS passage_id FROM sections WHERE title <> 'whole' AND title <> 'part 0'), go AS (SELECT * FROM cur WHERE id % 100000 = 2)
SELECT id, doc_id, "start", "end", passage_id FROM cur WHERE id % 100000 <> 2 UNION ALL SELECT go.id, go.doc_id, NULL, NULL, p.doc_id * 100000 + p.sort_order FROM go JOIN passages p ON p.doc_id = go.doc_id AND p.sort_order BETWEEN go."start" AND go."end"''')
def reshaped_ranges(t):
    cur = t("sections").filter("title <> 'whole' and title <> 'part 0'").select("id", "doc_id", "start", "end", F.lit(None).cast("long").alias("passage_id"), F.lit("t").alias("text"), (F.col("id") % 100000).alias("k"))
    rows = lines_of(t).withColumn("passage_id", F.col("doc_id") * 100000 + F.col("sort_order"))
    return P.reshape_ranges(cur, rows, [2], "k").select("id", "doc_id", "start", "end", "passage_id")


@query("owned_runs", """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS o FROM lineitem), x AS (SELECT k, 2 AS s, 3 AS e FROM (SELECT DISTINCT k FROM r)) SELECT x.k AS run, count(*) FILTER (n BETWEEN s AND e AND r.o = 'A') = 2 AS owned, count(*) FILTER (n < s AND r.o = 'A') = 0 AS strange_before, count(*) FILTER (n > e AND r.o = 'A') = 0 AS strange_after FROM x JOIN r ON r.k = x.k AND n BETWEEN s - 1 AND e + 1 GROUP BY x.k""")
def owned_runs(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("at"), F.col("l_returnflag").alias("o"))
    runs = rows.select("k").distinct().select(F.col("k").alias("run"), "k", F.lit("A").alias("o"), F.lit(2).alias("start"), F.lit(3).alias("end"))
    return P.owned_runs(rows, runs, "k", "at", "o")


_OLD_NEW = """old AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS g, l_linenumber * 10 AS "start", l_linenumber * 10 + 9 AS "end", l_returnflag AS text, CASE WHEN l_discount > 0.09 THEN 'manual' ELSE 'whole_unit' END AS method FROM lineitem),
new AS (SELECT l_orderkey AS g, l_linenumber * 10 AS "start", l_linenumber * 10 + 9 AS "end", CASE WHEN l_linestatus = 'O' THEN l_returnflag ELSE 'Z' END AS text FROM lineitem)"""


@query("replacement_ids", f"""WITH {_OLD_NEW}, f AS (SELECT g FROM old GROUP BY g HAVING count(*) FILTER (method = 'manual') = 0), o AS (SELECT g, bool_and(gap) AS ok FROM (SELECT g, coalesce(lag("end") OVER (PARTITION BY g ORDER BY "start") + 1 = "start", true) AS gap FROM new) GROUP BY g)
SELECT old.id FROM old JOIN f USING (g) JOIN o USING (g) WHERE ok AND NOT EXISTS (SELECT 1 FROM new n WHERE n.g = old.g AND n."start" = old."start" AND n."end" = old."end" AND n.text = old.text)""")
def replacement_ids(t):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    span = [F.col("l_orderkey").alias("g"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 9).alias("end")]
    old = t("lineitem").select(key.alias("id"), *span, F.col("l_returnflag").alias("text"), F.when(F.col("l_discount") > 0.09, "manual").otherwise("whole_unit").alias("method"))
    new = t("lineitem").select(*span, F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).otherwise("Z").alias("text"))
    return P.replacement_ids(old, new, "g", ["text"])


_MOVES = "moves AS (SELECT s_suppkey AS k, s_nationkey AS \"to\" FROM supplier WHERE s_acctbal > 0), stay AS (SELECT DISTINCT s_nationkey AS t FROM supplier WHERE NOT (s_acctbal > 0))"


@query("repoint_plan", f"WITH {_MOVES} SELECT k, \"to\", CASE WHEN EXISTS (SELECT 1 FROM stay WHERE t = \"to\") THEN 'blocked' ELSE 'move' END AS action FROM moves")
def repoint_plan(t):
    rows = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("target"), "s_acctbal")
    return P.repoint(rows, rows.filter("s_acctbal > 0").select("k", F.col("target").alias("to")), "k", "target").select("k", "to", "action")


@query("repoint_apply", "SELECT s_suppkey AS k, CASE WHEN s_acctbal > 0 THEN s_nationkey + 100 ELSE s_nationkey END AS target FROM supplier")
def repoint_apply(t):
    rows = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("target"), "s_acctbal")
    moves = P.repoint(rows, rows.filter("s_acctbal > 0").select("k", (F.col("target") + 100).alias("to")), "k", "target")
    return P.apply_repoint(rows.drop("s_acctbal"), moves, "k", "target").select("k", "target")


@query("version_bump", "SELECT n_name AS text, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 4 END AS version FROM nation WHERE n_nationkey < 2")
def version_bump(t):
    one = lambda k: P.bump_version(t("nation").filter(F.col("n_nationkey") == k).select(F.when(F.lit(k) == 0, F.col("n_name")).otherwise(F.lit("other")).alias("text"), F.lit(3).alias("version")), t("nation").filter(F.col("n_nationkey") == k).select(F.col("n_name").alias("text")), ["text"])
    return one(0).unionByName(one(1))


@query("feedback_rows", "SELECT doc_id, substring(trim(text), 1, 5000) AS message FROM documents WHERE trim(text) <> ''")
def feedback_rows(t):
    return sinks.feedback(t("documents").select("doc_id", F.col("text").alias("message")))


@query("split_body_items", "WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n')) AS text, generate_subscripts(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), 1) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) SELECT doc_id, CAST(n AS INTEGER) AS item_no, trim(text) AS text FROM p WHERE trim(text) <> ''")
def split_body_items(t):
    rows = t("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body"))
    return sinks.split_body(rows, "doc_id", "body", t("labels").select("doc_id").distinct())


@query("removed_by_key", "SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view') OR event_type IS NULL")
def removed_by_key(t):
    return P.without(t("events"), ["click", "view"], "event_type").select("event_id")


@query("truncated", "SELECT event_id FROM events WHERE false")
def truncated(t):
    return P.without(t("events"), [], "event_type").select("event_id")


@query("rekeyed", "SELECT d.source AS file_name, d.n_chars AS sort_order, l.quality FROM labels l JOIN documents d USING (doc_id)")
def rekeyed(t):
    passages = t("documents").select(F.col("doc_id").alias("passage_id"), F.col("source").alias("file_name"), F.col("n_chars").alias("sort_order"))
    return sinks.rekeyed(t("labels").select(F.col("doc_id").alias("passage_id"), "quality"), passages).select("file_name", "sort_order", "quality")


@query("preview_manifest", "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, sha256(text) AS text_sha256 FROM documents")
def preview_manifest(t):
    return sinks.previews(t("documents"), "doc_id", "text")


@query("book_order", "SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 1048576 END AS INTEGER) AS place, CAST(p_size AS BIGINT) AS number FROM part")
def book_order(t):
    uid = F.concat(F.get(F.array(F.lit("dn"), F.lit("mn"), F.lit("zz")), (F.col("p_partkey") % 3).cast("int")), F.col("p_size"))
    rows = readers.in_book_order(t("part").withColumn("uid", uid), "uid", ["mn", "dn"])
    return rows.select("p_partkey", F.col("book_order.group").cast("int").alias("place"), F.get("book_order.numbers", F.lit(0)).alias("number"))


@query("merged_segments", "SELECT doc_id, trim(regexp_replace(coalesce(lang, ''), '\\s+', ' ', 'g')) || chr(10) || source AS merged FROM documents")
def merged_segments(t):
    rows = t("documents").select("doc_id", F.concat(F.lit("<b>"), "lang", F.lit("</b> ")).alias("text"), F.concat(F.lit(" <i>"), "source", F.lit("</i>")).alias("comment"))
    return readers.merged_text(rows).select("doc_id", "merged")


@query("profile_drift", "SELECT lang, 'n' AS \"column\", CAST(count(*) AS VARCHAR) AS golden, CAST(count(*) FILTER (n_chars > 100) AS VARCHAR) AS now FROM documents GROUP BY lang HAVING count(*) <> count(*) FILTER (n_chars > 100)")
def profile_drift(t):
    count = lambda rows: rows.groupBy("lang").agg(F.count("*").alias("n"))
    return readers.profiles_differ(count(t("documents")), count(t("documents").filter("n_chars > 100")), "lang", ["n"])


@query("title_forms", f"""WITH {PASSAGES}, x AS (SELECT doc_id, sort_order, '(' || (sort_order + 1) || ') ' || coalesce(string_split(text, ' ')[1], '') AS title FROM passages), f AS (SELECT doc_id, sort_order, regexp_replace(title, '^\\s*\\(?\\d+(?:[-.]\\d+)*[.)]*\\s*', '') AS bare FROM x)
SELECT doc_id, sort_order, bare, replace({fold_sql('bare')}, ' ', '') AS stem FROM f""")
def title_forms(t):
    rows = lines_of(t).withColumn("title", F.concat(F.lit("("), F.col("sort_order") + 1, F.lit(") "), F.coalesce(F.get(F.split("text", " "), F.lit(0)), F.lit(""))))
    return rows.select("doc_id", "sort_order", T.strip_number(F.col("title")).alias("bare"), T.heading_stem(F.col("title")).alias("stem"))


@query("mended_marks", "SELECT p_partkey, 'a, b' || p_name || ' c. d' AS text FROM part")
def mended_marks(t):
    damaged = F.concat(F.lit("a ,b"), "p_name", F.lit("​ c . d"))
    return t("part").select("p_partkey", T.punctuation_spacing(T.artifacts(damaged)).alias("text"))


@query("elided_prefixes", f"WITH {PASSAGES} SELECT doc_id, sort_order, trim(regexp_replace(regexp_replace(text, '(?s)[,].*$', '', 'g'), '\\s+', ' ', 'g')) AS prefix FROM passages WHERE contains(text, ',')")
def elided_prefixes(t):
    rows = lines_of(t).filter(F.contains("text", F.lit(",")))
    return rows.select("doc_id", "sort_order", T.elided_prefix(F.regexp_replace("text", "(?s),.*$", "… pe more")).alias("prefix"))


@query("vocabulary_words", "SELECT DISTINCT lower(trim(p_type)) AS word FROM part WHERE trim(p_type) <> ''")
def vocabulary_words(t):
    return t("part").select(F.lower(F.trim("p_type")).alias("word")).filter("word <> ''").distinct()


@query("bilingual_segments", """WITH s AS (SELECT conv_id AS work, turn AS item, lower(text) AS folded FROM conversations WHERE role = 'user' AND text <> ''), p AS (SELECT conv_id AS work, turn AS at, lower(text) AS folded FROM conversations WHERE role <> 'user')
SELECT s.work, s.item, p.at, CAST(least(3.0, length(s.folded) / 60) AS DOUBLE) AS weight FROM s JOIN p USING (work) WHERE contains(p.folded, s.folded)""")
def bilingual_segments(t):
    """Turns of a user that an answer of the same conversation holds."""
    rows = t("conversations").filter("text <> ''")
    low = F.lower("text")
    segments = rows.filter("role = 'user'").select(F.col("conv_id").alias("work"), F.col("turn").alias("item"), low.alias("folded"))
    passages = rows.filter("role <> 'user'").select(F.col("conv_id").alias("doc"), F.col("turn").alias("at"), low.alias("folded"), F.lit("no mark").alias("text"))
    works = rows.groupBy(F.col("conv_id").alias("work")).agg(F.min("turn").alias("start"), F.max("turn").alias("end")).withColumn("doc", F.col("work"))
    found = D.segment_candidates(segments, passages, works)
    return found.join(segments.withColumnRenamed("folded", "f"), ["work", "item"]).join(passages.select(F.col("doc").alias("work"), "at", F.col("folded").alias("g")), ["work", "at"]).filter(F.contains("g", F.col("f"))).select("work", "item", "at", "weight")
