"""Queries over the relational tables: joins, aggregates, paging, snapshots and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit as U
from ..operators import ranking as K
from ..operators import upsert as P
from ..sources import sinks
from ..streaming import log
from .base import query

# Parts of a group of the self-join, and its tasks.
PARTS, CELLS = 8, 384


@query("star_join", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F'")
def star_join(t):
    dims = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t("orders").filter("o_orderstatus = 'F'").join(dims, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query("nullsafe_selfjoin", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey IS NOT DISTINCT FROM b.c_nationkey AND a.c_mktsegment IS NOT DISTINCT FROM b.c_mktsegment AND a.c_custkey < b.c_custkey")
def nullsafe_selfjoin(t):
    """All pairs of a group, whose number is the job's own: a group is dealt to cells of two parts each, so that the few
    groups do not make the tasks and each pair is looked at once."""
    part = F.pmod(F.xxhash64("c_custkey"), F.lit(PARTS)).cast("int")
    rows = t("customer").filter("c_custkey is not null").select("c_custkey", F.struct("c_nationkey", "c_mktsegment").alias("g"), part.alias("p"))
    a = rows.select(F.col("c_custkey").alias("x"), "g", F.col("p").alias("i"), F.explode(F.sequence("p", F.lit(PARTS - 1))).alias("j"))
    b = rows.select(F.col("c_custkey").alias("y"), "g", F.col("p").alias("j"), F.explode(F.sequence(F.lit(0), "p")).alias("i"))
    a, b = (d.repartition(CELLS, "g", "i", "j") for d in (a, b))  # fields of a struct are equal if both are null
    met = a.hint("merge").join(b, ["g", "i", "j"]).filter("i < j or x < y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


@query("anti_unmatched", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_unmatched(t):
    return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("semi_docs", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_docs(t):
    return t("documents").select("doc_id", "lang").join(t("labels").filter("quality = 1"), "doc_id", "left_semi")


@query("exists_flag", "SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS labelled FROM documents d")
def exists_flag(t):
    have = t("labels").select("doc_id").distinct().withColumn("x", F.lit(True))
    return t("documents").select("doc_id").join(have, "doc_id", "left").select("doc_id", F.col("x").isNotNull().alias("labelled"))


@query("ordered_lookup", "SELECT pos, o_orderkey, o_totalprice FROM (VALUES (0, 7), (1, 3), (2, 5), (3, 1)) v(pos, id) JOIN orders ON o_orderkey = id")
def ordered_lookup(t):
    ids = t("orders").sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, (7, 3, 5, 1)))).alias("pos", "id"))
    return t("orders").join(F.broadcast(ids), F.col("o_orderkey") == F.col("id")).select("pos", "o_orderkey", "o_totalprice")  # four literal ids


@query("log_counts", "SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (props IS NULL) AS empty FROM events")
def log_counts(t):
    return t("events").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("props").isNull()).alias("empty"))


@query("log_top10", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def log_top10(t):
    return U.top_values(t("events"), "user_id")


@query("log_keyset_page", "SELECT event_id, event_type FROM events WHERE (ts, event_id) < (SELECT (max(ts), CAST(0 AS BIGINT)) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 21")
def log_keyset_page(t):
    last = t("events").agg(F.max("ts").alias("ts")).select("ts", F.lit(0).cast("long").alias("id"))
    cursor = t("events").join(F.broadcast(last.select(F.struct(F.col("ts").alias("ts"), F.col("id").alias("event_id")).alias("c"))))  # one row
    return cursor.filter(F.struct("ts", "event_id") < F.col("c")).orderBy(F.desc("ts"), F.desc("event_id")).limit(21).select("event_id", "event_type")


@query("log_ilike_filter", "SELECT event_id FROM events WHERE event_type ILIKE '%CLI%' AND coalesce(value, 0) > 0")
def log_ilike_filter(t):
    return t("events").filter(F.col("event_type").ilike("%CLI%") & (F.coalesce("value", F.lit(0)) > 0)).select("event_id")


@query("log_windowed_counts", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def log_windowed_counts(t):
    return log.windowed_counts(t("events"), "ts", "event_type").select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("date_format_report", "SELECT event_id, strftime(ts, '%H:%M:%S %d/%m/%Y') AS shown FROM events")
def date_format_report(t):
    return t("events").select("event_id", F.date_format("ts", "HH:mm:ss dd/MM/yyyy").alias("shown"))


@query("coverage_having", "SELECT lang, source, count(*) AS n, count(l.doc_id) AS covered, round(100.0 * count(l.doc_id) / count(*), 2) AS percent FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang, source HAVING count(l.doc_id) > 0")
def coverage_having(t):
    return U.coverage(t("documents"), t("labels"), "doc_id", ["lang", "source"])


@query("count_distinct_by_regex_key", r"SELECT regexp_replace(p_type, '\s.*$', '') AS key, count(DISTINCT p_brand) AS brands, count(*) AS n FROM part GROUP BY 1")
def count_distinct_by_regex_key(t):
    return t("part").groupBy(F.regexp_replace("p_type", r"\s.*$", "").alias("key")).agg(F.countDistinct("p_brand").alias("brands"), F.count("*").alias("n"))


@query("count_filter", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS high, min(l_quantity) AS low, max(l_shipdate)::DATE::VARCHAR AS last FROM lineitem GROUP BY l_returnflag")
def count_filter(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("high"), F.min("l_quantity").alias("low"), F.max("l_shipdate").cast("date").cast("string").alias("last"))


@query("array_agg_ordered", "SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey), ',') AS parts FROM lineitem GROUP BY l_orderkey")
def array_agg_ordered(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    return g.select("l_orderkey", F.array_join(F.transform("p", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("distinct_on_latest", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS n FROM orders) WHERE n = 1")
def distinct_on_latest(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey")
    return t("orders").withColumn("n", F.row_number().over(w)).filter("n = 1").select("o_custkey", "o_orderkey")


@query("group_outliers", "WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS m, count(*) AS n FROM lineitem GROUP BY l_suppkey) SELECT l_orderkey, l_linenumber, round(l_extendedprice / m, 4) AS ratio FROM lineitem JOIN m USING (l_suppkey) WHERE n >= 4 AND m > 0 AND (l_extendedprice / m < 0.75 OR l_extendedprice / m > 1.25)")
def group_outliers(t):
    return U.group_outliers(t("lineitem"), "l_suppkey", "l_extendedprice").select("l_orderkey", "l_linenumber", F.round("ratio", 4).alias("ratio"))


@query("numeric_text_guard", r"SELECT source, min(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER)) AS lo, count(*) AS n FROM documents WHERE regexp_matches(source, '[0-9]+$') GROUP BY source")
def numeric_text_guard(t):
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int")
    return t("documents").filter(F.col("source").rlike("[0-9]+$")).groupBy("source").agg(F.min(number).alias("lo"), F.count("*").alias("n"))


@query("set_union_distinct", "SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels")
def set_union_distinct(t):
    return t("documents").filter("lang = 'en'").select("doc_id").union(t("labels").select("doc_id")).distinct()


@query("set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left_anti").distinct()


@query("set_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def set_intersect(t):
    return t("documents").select("doc_id").intersect(t("labels").filter("toxic = 1").select("doc_id"))


@query("offset_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 50")
def offset_page(t):
    return t("orders").orderBy("o_orderdate", "o_orderkey").offset(50).limit(25).select("o_orderkey")


@query("json_fields", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first FROM events WHERE props IS NOT NULL")
def json_fields(t):
    rows = t("events").filter("props is not null").select("event_id", "props", F.get(F.json_object_keys("props"), F.lit(0)).alias("k"))
    return rows.select("event_id", F.element_at(F.from_json("props", "map<string,string>"), F.col("k")).alias("first"))


@query("running_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step FROM orders")
def running_total(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), (F.col("o_orderkey") - F.lag("o_orderkey").over(w)).alias("step"))


def _versions(t):
    """Two snapshots of translations: of all labelled documents, and of all documents, with other texts and methods."""
    method = lambda c, *names: F.when(c == 0, names[0]).when(c == 1, names[1]).otherwise(names[2] if len(names) > 2 else None)
    old = t("labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("x")).select("doc_id", F.concat(F.lit("text "), F.col("q")).alias("text"), method(F.col("q") + F.col("x"), "heuristic", "strict_unique", "manual").alias("method"))
    digit = F.right("source", F.lit(1)).try_cast("int")
    new = t("documents").select("doc_id", F.concat(F.lit("text "), (F.col("n_chars") > 600).cast("int").cast("string")).alias("text"), method(digit, "manual", "strict_unique").alias("method"), "lang")
    return old, new.drop("lang")


_R = "CASE {0} WHEN 'manual' THEN 50 WHEN 'strict_unique' THEN 40 WHEN 'heuristic' THEN 10 ELSE 0 END"
_VERSIONS = """o AS (SELECT doc_id, 'text ' || max(quality) AS text, CASE max(quality) + max(toxic) WHEN 0 THEN 'heuristic' WHEN 1 THEN 'strict_unique' ELSE 'manual' END AS method FROM labels GROUP BY doc_id),
n AS (SELECT doc_id, 'text ' || CAST(n_chars > 600 AS INTEGER) AS text, CASE right(source, 1) WHEN '0' THEN 'manual' WHEN '1' THEN 'strict_unique' END AS method FROM documents)"""


@query("precedence_upsert", f"""WITH {_VERSIONS}, j AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, o.text AS ot, o.method AS om, n.text AS nt, n.method AS nm, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'keep'
  WHEN {_R.format('n.method')} > {_R.format('o.method')} OR ({_R.format('n.method')} = {_R.format('o.method')} AND n.text IS DISTINCT FROM o.text) THEN 'update' ELSE 'keep' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id)
SELECT doc_id, CASE action WHEN 'keep' THEN ot ELSE nt END AS text, CASE action WHEN 'keep' THEN om ELSE nm END AS method, action FROM j""")
def precedence_upsert(t):
    return P.precedence_upsert(*_versions(t), ["doc_id"], ["text"])


@query("plan_actions", f"""WITH {_VERSIONS} SELECT n.doc_id, CASE WHEN n.method = 'manual' THEN 'blocked' WHEN o.doc_id IS NULL THEN 'insert' WHEN o.text IS NOT DISTINCT FROM n.text AND o.method IS NOT DISTINCT FROM n.method THEN 'unchanged' ELSE 'update' END AS action FROM n LEFT JOIN o USING (doc_id)""")
def plan_actions(t):
    old, new = _versions(t)
    return P.plan(old, new, ["doc_id"], ["text", "method"], F.coalesce(F.col("method") == "manual", F.lit(False))).select("doc_id", "action")


@query("archive_split", f"WITH {_VERSIONS} SELECT o.*, 'b2' AS replaced_by_batch FROM o WHERE doc_id IN (SELECT doc_id FROM n)")
def archive_split(t):
    old, new = _versions(t)
    return P.archive_split(old, new.select("doc_id"), "doc_id", "b2")[1]


@query("last_writer_upsert", f"WITH {_VERSIONS}, u AS (SELECT *, 1 AS batch FROM o UNION ALL SELECT *, 2 FROM n) SELECT doc_id, text, method, batch FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY batch DESC) AS k FROM u) WHERE k = 1")
def last_writer_upsert(t):
    old, new = _versions(t)
    return P.last_writer(old.withColumn("batch", F.lit(1)), new.withColumn("batch", F.lit(2)), ["doc_id"], "batch")


@query("guarded_insert_not_exists", f"WITH {_VERSIONS} SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id IS NOT DISTINCT FROM n.doc_id AND o.method IS NOT DISTINCT FROM n.method)")
def guarded_insert_not_exists(t):
    old, new = _versions(t)
    return P.append_new(old, new, ["doc_id", "method"])


@query("sync_children", f"WITH {_VERSIONS} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' WHEN o.text IS NOT DISTINCT FROM n.text THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def sync_children(t):
    return P.sync_children(*_versions(t), "doc_id", ["text"])


@query("compare_and_swap", f"WITH {_VERSIONS} SELECT o.doc_id, CASE WHEN n.doc_id IS NOT NULL AND o.text = 'text 1' THEN n.text ELSE o.text END AS text FROM o LEFT JOIN n USING (doc_id)")
def compare_and_swap(t):
    old, new = _versions(t)
    edits = new.select("doc_id", F.lit("text 1").alias("old"), F.col("text").alias("new"))
    return P.compare_and_swap(old, edits, "doc_id", "text").select("doc_id", "text")


@query("contiguous_ranges", 'WITH r AS (SELECT l_orderkey AS g, l_linenumber * 10 AS "start", l_linenumber * 10 + 9 - l_linenumber % 3 // 2 AS "end" FROM lineitem), x AS (SELECT g, coalesce(lag("end") OVER (PARTITION BY g ORDER BY "start") + 1 <> "start", false) AS gap FROM r) SELECT g, count(*) AS n, bool_and(NOT gap) AS complete FROM x GROUP BY g')
def contiguous_ranges(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 9 - F.expr("l_linenumber % 3 div 2")).alias("end"))
    return P.complete_runs(rows, "g")


@query("count_reconciliation", "WITH a AS (SELECT lang, count(*) AS l FROM documents GROUP BY lang), b AS (SELECT lang, count(*) AS r FROM documents WHERE n_chars > 500 GROUP BY lang) SELECT lang, coalesce(l, 0) AS left_n, coalesce(r, 0) AS right_n FROM a FULL JOIN b USING (lang) WHERE coalesce(l, 0) <> coalesce(r, 0)")
def count_reconciliation(t):
    return U.reconcile(t("documents"), t("documents").filter("n_chars > 500"), "lang")


@query("majority_vote", "WITH n AS (SELECT l_orderkey, l_suppkey, count(*) AS hits FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(hits) OVER w, 0) AS second FROM n WINDOW w AS (PARTITION BY l_orderkey ORDER BY hits DESC, l_suppkey)) SELECT l_orderkey, l_suppkey, hits, second FROM r WHERE k = 1 AND hits >= 2 AND hits > second")
def majority_vote(t):
    return U.vote(t("lineitem"), "l_orderkey", "l_suppkey")


@query("sql_dump", "SELECT 'insert into nation (n_nationkey, n_name, n_regionkey) select ' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ' where not exists (select 1 from nation where n_nationkey is not distinct from ' || n_nationkey || ');' AS value FROM nation")
def sql_dump(t):
    return sinks.insert_statements(t("nation"), "nation", ["n_nationkey"])


@query("cube_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("keyset_next_page", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 11")
def keyset_next_page(t):
    return K.keyset_page(t("events"), "ts", "event_id", 10).select("event_id")
