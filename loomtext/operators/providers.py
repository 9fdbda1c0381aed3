"""Hooks for models outside the engine: read-through caches and guards. No provider is set by default."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_cached(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with their cached payload, rows to ask for)."""
    return wanted.join(cache, keys), wanted.join(cache, keys, "left_anti")


def call_in_batches(rows: DataFrame, text: str, provider: Callable[[list[str]], list[str]], size: int = 64) -> DataFrame:
    """rows with `payload` from the provider, asked in batches; a batch whose answer has another length is null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list[str | None] = []
            for a in range(0, len(part), size):
                asked = part[text].iloc[a : a + size].tolist()
                got = provider(asked)
                out += got if len(got) == len(asked) else [None] * len(asked)
            yield part.assign(payload=out)

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", payload string")


def read_through(wanted: DataFrame, cache: DataFrame, keys: list[str], text: str, provider: Callable[[list[str]], list[str]]) -> tuple[DataFrame, DataFrame]:
    """(all rows with payload, new cache rows); nothing already cached is asked for or replaced."""
    have, missing = split_cached(wanted, cache, keys)
    new = call_in_batches(missing.dropDuplicates(keys), text, provider).filter("payload is not null")
    fresh = new.select(*keys, "payload")
    return have.select(*wanted.columns, "payload").unionByName(missing.join(fresh, keys, "left").select(*wanted.columns, "payload")), fresh


def resolve(*texts: Column) -> Column:
    """The first source that has a text."""
    return F.coalesce(*(F.when(F.trim(t) != "", t) for t in texts))


def allowed_only(ids: Column, allowed: Column) -> Column:
    return F.array_intersect(ids, allowed)


def tolerant_json(payload: Column, schema: str) -> Column:
    """JSON out of an answer that may wrap it in a fence or a sentence."""
    body = F.regexp_extract(payload, r"(?s)([\{\[].*[\}\]])", 1)
    return F.from_json(F.when(body != "", body).otherwise(payload), schema)


class Registry:
    """Functions by a source's name: text repairs, or fetchers of translations, in the order of display."""

    def __init__(self, **functions: Callable):
        self.functions = dict(functions)

    def repair(self, source: Column, text: Column) -> Column:
        """Each source's texts by its function, others as they are."""
        out = text
        for name, f in self.functions.items():
            out = F.when(source == name, f(text)).otherwise(out)
        return out

    def ordered(self, rows: DataFrame, source: str) -> DataFrame:
        """rows with `source_order`; sources that are not known come last."""
        place = F.array_position(F.array(*map(F.lit, self.functions)), F.col(source))
        return rows.withColumn("source_order", F.when(place > 0, place).otherwise(len(self.functions) + 1).cast("int"))


def source_options(order: list[str], data: DataFrame, source: str, always: str | None = None, stands_in: dict[str, str] | None = None) -> DataFrame:
    """(value, position, available): all sources in order; one is available if it has rows, if the one that stands in for it
    has, or always."""
    have = data.select(F.col(source).alias("value")).distinct().withColumn("h", F.lit(True))
    rows = data.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, order))).alias("position", "value"))
    other = F.lit(None).cast("string")
    for k, v in (stands_in or {}).items():
        other = F.when(F.col("value") == k, v).otherwise(other)
    rows = rows.withColumn("other", other).join(have, "value", "left").join(have.withColumnsRenamed({"value": "other", "h": "h2"}), "other", "left")
    return rows.select("value", "position", (F.coalesce("h", "h2", F.lit(False)) | F.coalesce(F.col("value") == F.lit(always), F.lit(False))).alias("available"))


def passage_texts(passages: DataFrame, translations: DataFrame, source: str, key: str) -> DataFrame:
    """A source's translations of single passages."""
    own = translations.filter((F.col("source") == source) & F.col("start").isNull()).select(key, "text")
    return passages.join(own, key)


def in_turn(providers: list[Callable[[list[str]], list[str]]]) -> Callable[[list[str]], list[str]]:
    """One provider after the other until one answers; the next call begins behind the one that did."""
    at = [0]

    def ask(texts: list[str]) -> list[str]:
        last: Exception | None = None
        for k in range(len(providers)):
            i = (at[0] + k) % len(providers)
            try:
                out = providers[i](texts)
            except Exception as e:  # noqa: BLE001  whatever a model outside raises
                last = e
                continue
            at[0] = (i + 1) % len(providers)
            return out
        raise RuntimeError("no provider answered") from last

    return ask


class ResultCache:
    """Ranked lists of a driver's recent searches: at most `size`, none older than `seconds`; the longest unused goes first."""

    def __init__(self, size: int = 32, seconds: float = 600.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock, self.held = size, seconds, clock, OrderedDict()

    def get(self, key):
        if key not in self.held or self.clock() - self.held[key][0] > self.seconds:
            self.held.pop(key, None)
            return None
        self.held.move_to_end(key)
        return self.held[key][1]

    def put(self, key, value) -> None:
        self.held[key] = self.clock(), value
        self.held.move_to_end(key)
        while len(self.held) > self.size:
            self.held.popitem(last=False)
