"""The registry of queries, and what their SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import INVISIBLE, MARKED, PLAIN
from ..sources.readers import passages, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Tables = Callable[[str], DataFrame]


def query(name: str, sql: str | None = None):
    """Registers f(t), which gets tables by name, as the query `name`."""

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda x: passages(table(spark, sf_dir, "documents")) if x == "passages" else sections(table(spark, sf_dir, "documents")) if x == "sections" else table(spark, sf_dir, x))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def sections(documents: DataFrame) -> DataFrame:
    """(id, doc_id, title, path, start, end): each document as a whole and in parts of four lines, of which the first
    reaches too far."""
    rows = documents.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long").alias("n"))
    whole = rows.select((F.col("doc_id") * 100000).alias("id"), "doc_id", F.lit("whole").alias("title"), F.array(F.lit("d")).alias("path"), F.lit(0).cast("long").alias("start"), (F.col("n") - 1).alias("end"))
    part = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 4"))).alias("k"))
    name = F.concat(F.lit("part "), F.col("k").cast("string"))
    end = F.when(F.col("k") == 0, F.col("n") - 1).otherwise(F.least(F.col("k") * 4 + 3, F.col("n") - 1))
    parts = part.select((F.col("doc_id") * 100000 + F.col("k") + 1).alias("id"), "doc_id", name.alias("title"), F.array(F.lit("d"), name).alias("path"), (F.col("k") * 4).alias("start"), end.alias("end"))
    return whole.unionByName(parts)


PASSAGES = """passages AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS sort_order FROM documents
)"""
SECTIONS = """sizes AS (SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n FROM documents), sections AS (
  SELECT doc_id * 100000 AS id, doc_id, 'whole' AS title, ['d'] AS path, CAST(0 AS BIGINT) AS "start", n - 1 AS "end" FROM sizes
  UNION ALL SELECT doc_id * 100000 + k + 1, doc_id, 'part ' || k, ['d', 'part ' || k], k * 4, CASE WHEN k = 0 THEN n - 1 ELSE least(k * 4 + 3, n - 1) END
  FROM (SELECT doc_id, n, unnest(range((n - 1) // 4 + 1)) AS k FROM sizes)
)"""


def fold_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(translate(lower(nfc_normalize(regexp_replace({x}, '{INVISIBLE}', '', 'g'))), '{MARKED}', '{PLAIN}'), '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


def folded(name: str = "f", source: str = "passages") -> str:
    return f"{name} AS (SELECT *, {fold_sql('text')} AS folded FROM {source})"


def stem_sql(x: str, term: str) -> str:
    return rf"regexp_matches({x}, '(^|\s){term}\p{{L}}*($|\s)')"


def hits_sql(x: str, terms) -> str:
    return "(" + " + ".join(f"CAST({stem_sql(x, t)} AS INTEGER)" for t in terms) + ")"


def prefix_sql(x: str, term: str) -> str:
    return f"contains(' ' || {x}, ' {term}')"


def proximity_sql(x: str, terms) -> str:
    at = f"list_filter(list_transform(string_split({x}, ' '), lambda w, i: CASE WHEN {' OR '.join(f"starts_with(w, '{t}')" for t in terms)} THEN i END), lambda i: i IS NOT NULL)"
    return f"(CASE WHEN len({at}) < 2 THEN 0.0 ELSE 1 / ln(list_max({at}) - list_min({at}) + 3) END)"
