"""What both vector searches share: which rows take part, and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(rows: DataFrame) -> DataFrame:
    """Distinct (vec_id, v: array<double>) of the rows (vec_id, embedding) whose embedding has only finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("embedding").cast("array<double>")
    return rows.select("vec_id", v.alias("v")).filter("vec_id is not null and v is not null").filter(F.forall("v", fine)).distinct()


def block_of(key: Column, blocks: int | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int")
