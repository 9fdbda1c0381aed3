"""Sinks: Parquet snapshots, SQL dumps, preview texts with manifests, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def write_snapshot(df: DataFrame, path: str, mode: str = "errorifexists", partition: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition) if partition else w).parquet(path)


def literal(c: Column, numeric: bool) -> Column:
    text = c.cast("string")
    return F.coalesce(text if numeric else F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("null"))


def insert_statements(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """One idempotent statement per row, as `value`: it inserts only where no row has the keys."""
    own = {f.name: literal(F.col(f.name), isinstance(f.dataType, NumericType)) for f in df.schema}
    same = F.concat_ws(" and ", *(F.concat(F.lit(f"{k} is not distinct from "), own[k]) for k in keys))
    return df.select(F.concat(F.lit(f"insert into {name} ({', '.join(own)}) select "), F.concat_ws(", ", *own.values()), F.lit(f" where not exists (select 1 from {name} where "), same, F.lit(");")).alias("value"))


def write_dump(df: DataFrame, name: str, keys: list[str], path: str) -> None:
    insert_statements(df, name, keys).write.text(path)


def previews(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each text's manifest entry."""
    return df.select(key, F.length(text).alias("chars"), F.sha2(F.col(text).cast("binary"), 256).alias("text_sha256"))


def feedback(df: DataFrame, most: int = 5000) -> DataFrame:
    """Messages that are not empty, cut to the most characters that the form takes."""
    return df.withColumn("message", F.substring(F.trim("message"), 1, most)).filter("message <> ''")


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def split_body(df: DataFrame, key: str, body: str, existing: DataFrame) -> DataFrame:
    """Items (key, item_no, text) of bodies split at blank lines, for parents that have none yet."""
    items = df.join(existing, key, "left_anti").select(key, F.posexplode(F.split(body, r"\n\s*\n")).alias("p", "text"))
    return items.select(key, (F.col("p") + 1).alias("item_no"), F.trim("text").alias("text")).filter("text <> ''")


def rekeyed(rows: DataFrame, passages: DataFrame, key: str = "passage_id") -> DataFrame:
    """rows under (file_name, sort_order), which outlives the databases' own keys, in place of the passage's id."""
    return rows.join(passages.select(key, "file_name", "sort_order"), key).drop(key)


def write_previews(df: DataFrame, key: str, text: str, path: str) -> None:
    """Each text as a file of its own partition and a manifest with its size and digest beside them."""
    df.select(key, text).write.partitionBy(key).text(f"{path}/texts")
    previews(df, key, text).write.json(f"{path}/manifest")
