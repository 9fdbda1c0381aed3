"""Sources: landed files of several kinds, each read in parallel."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(documents: DataFrame) -> DataFrame:
    """(doc_id, sort_order, text, lang, source): the lines of documents as ordered passages."""
    return documents.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("sort_order", "text"))


def segments(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """(file, key, column) of JSON files that map segment keys to texts."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    clean = F.replace(F.col("value"), F.lit("﻿"), F.lit(""))
    return raw.select("file", F.explode(F.from_json(clean, "map<string,string>")).alias("key", column))


def triplets(root: DataFrame, translation: DataFrame, comments: DataFrame, key: str = "key") -> DataFrame:
    return root.join(translation, key, "full").join(comments, key, "full")


def web_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, html) of HTML files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("html"))


def file_tree(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(uid, path, length, sha256) of the files below path whose name matches; the pattern's first group is the uid."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("uid", F.regexp_extract("path", pattern, 1)).filter("uid <> ''").select("uid", "path", "length", F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, path: str, version: int, mode: str) -> DataFrame:
    """The items of a manifest with `problem`, null for those that agree with what the manifest says of them."""
    m = spark.read.option("multiLine", "true").json(path)
    counts = F.col("total_units") == F.size("items")
    head = F.when(F.col("schema_version") != version, "version").when(F.col("mode") != mode, "mode").when(~counts, "count")
    items = m.select(head.alias("__head"), F.explode("items").alias("i")).select("__head", "i.*")
    own = F.when(F.sha2(F.col("text").cast("binary"), 256) != F.col("text_sha256"), "hash")
    return items.withColumn("problem", F.coalesce("__head", own)).drop("__head")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()


def settings_row(spark: SparkSession, path: str, defaults: dict[str, str]) -> DataFrame:
    """A one-row JSON file's fields, with defaults for those it lacks."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(*(F.coalesce(F.get_json_object("value", f"$.{k}"), F.lit(v)).alias(k) for k, v in defaults.items()))


def jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A database table or query, read in ranges of a numeric column (column, low, high, parts)."""
    r = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **options)
    if partition:
        column, low, high, parts = partition
        r = r.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return r.load()


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text); needs pypdf on the executors."""

    def read(parts):
        import io

        import pandas as pd
        import pypdf

        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                texts = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]
                yield pd.DataFrame({"path": name, "page": range(len(texts)), "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, page int, text string")


def database_url(url: str, kept: Iterable[str] = ("sslmode", "connect_timeout", "application_name", "options")) -> str:
    """A database address with those of its parameters that drivers know."""
    head, _, rest = url.partition("?")
    pairs = [p for p in rest.split("&") if p.split("=", 1)[0] in set(kept)]
    return head + ("?" + "&".join(pairs) if pairs else "")


def options(spark: SparkSession, defaults: dict[str, str], prefix: str = "loomtext.") -> dict[str, str]:
    """Settings by name: the session's own, or else the defaults."""
    return {k: spark.conf.get(f"{prefix}{k}", v) for k, v in defaults.items()}


def large_enough(files: DataFrame, least: int = 10_000) -> DataFrame:
    """Landed files that are no broken download."""
    return files.filter(F.col("length") > least)


def in_book_order(rows: DataFrame, uid: str, groups: Iterable[str] = ()) -> DataFrame:
    """rows with `book_order`: the place of the uid's letters among the groups, then its numbers."""
    letters = F.regexp_extract(uid, r"^([a-z-]*)", 1)
    place = F.array_position(F.array(*map(F.lit, groups)), letters) if groups else F.lit(0)
    numbers = F.transform(F.regexp_extract_all(uid, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    return rows.withColumn("book_order", F.struct(F.when(place > 0, place).otherwise(1 << 20).alias("group"), letters.alias("letters"), numbers.alias("numbers")))


def merged_text(triplets_: DataFrame, text: str = "text", comment: str = "comment") -> DataFrame:
    """triplets with `merged`: each segment's text with its comment behind it, tags and single spaces aside."""
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", ""), r"\s+", " "))
    return triplets_.withColumn("merged", F.array_join(F.filter(F.array(bare(F.col(text)), bare(F.col(comment))), lambda x: x != ""), "\n"))


def profiles_differ(golden: DataFrame, now: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, golden, now): where a profile differs from the stored one."""
    long = lambda df, name: df.select(key, F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string"))))).alias("column", name))
    return long(golden, "golden").join(long(now, "now"), [key, "column"], "full").filter(~F.col("golden").eqNullSafe(F.col("now")))
