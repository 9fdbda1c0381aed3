"""Language identification by word-first backoff.

Learning counts words and, from the same words, character 1- to 4-grams (with word borders) per language over all
training documents. A word is known from `least` occurrences on. The known words with the largest counts are broadcast,
as many as `cells` numbers allow; all others stay in a table, of which a Bloom filter of bounded size is broadcast. Grams
are chosen by their largest share in any language, so that a language with few documents keeps its own, and are broadcast,
at most `max_grams` of each order: only what an unknown word is told by is bounded.

A known word scores by its smoothed log frequency in each language, relative to all languages; an unknown word by the
mean over its longest known grams: 4-grams, or else 3-, 2- and 1-grams. A text is first scored with the broadcast words,
others by grams; those of them that pass the filter are then joined to the table, each with the difference that knowing it
makes, so that no known word is left out. A document's score is the posterior of the best language, words and languages'
shares of the training documents taken as independent.

Defined cases: a null text, or one without a letter, is `und` with score 0 (letters are those of Unicode: numerals are
none); so is every text if nothing could be learned; rows with a null lang or text teach nothing; ties go to the first
language in alphabetical order; repeated rows count as often as they stand; an empty table gives no rows; rows with equal
or null ids are predicted each on its own; a very long text is read whole; other columns, whatever their names, are
passed through by `known_language` and ignored by the query.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_fold, most_frequent, staged, table

WORDS = re.compile(r"[^\W\d_]+")  # letters, and numerals that are no digits; words_of parts these
ORDERS = (4, 3, 2, 1)
FLUSH, KEPT, BLOOM = 150_000, 200_000, 1 << 25


def letters(found: Counter) -> Counter:
    """Counts of what WORDS found, words with numerals parted into runs of letters."""
    for w in [w for w in found if not w.isalpha()]:
        times = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += times
    return found


def words_of(text: str) -> Counter:
    """Runs of letters, lower-cased, with their counts."""
    return letters(Counter(WORDS.findall(text.lower())))


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(gram, lang, n) of the words. Memory is bounded by FLUSH distinct words."""
    words: dict[str, Counter] = {}

    def flush() -> pd.DataFrame:
        for own in words.values():
            letters(own)
        out = pd.DataFrame({"gram": [w for own in words.values() for w in own], "lang": [x for x, own in words.items() for _ in own], "n": np.array([c for own in words.values() for c in own.values()], np.int64)})
        words.clear()
        return out

    for part in parts:
        size = 0
        for text, lang in zip(part["text"], part["lang"]):
            own = words.setdefault(lang, Counter())
            size -= len(own)
            own.update(WORDS.findall(text.lower()))
            size += len(own)
            if size > FLUSH and len(out := flush()):
                yield out
                size = 0
        if sum(map(len, words.values())) > FLUSH // 2 and len(out := flush()):
            yield out
    if len(out := flush()):
        yield out


def _grams(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, gram, lang, n) of the words' grams; kind is the gram's order."""
    for part in parts:
        out: Counter = Counter()
        for w, lang, c in zip(part["gram"], part["lang"], part["n"]):
            for n in ORDERS:
                for g in grams(w, n):
                    out[n, g, lang] += c
        yield pd.DataFrame({"kind": np.array([k[0] for k in out], np.int32), "gram": [k[1] for k in out], "lang": [k[2] for k in out], "n": np.fromiter(out.values(), np.int64, len(out))})


class Model:
    """rows: log shares of the known words, and behind them those of unseen words met so far."""

    def __init__(self, langs: list[str], prior: np.ndarray, tables: dict[int, tuple[list[str], np.ndarray]]):
        """tables: by kind (0: words, else the grams' order), the grams and their rows of log shares, held in the broadcast."""
        self.langs, self.prior = langs, prior
        self.known = {w: i for i, w in enumerate(tables[0][0])} if tables else {}
        self.words = tables[0][1] if tables else np.zeros((0, 0), np.float32)
        self.grams = {n: {g: i for i, g in enumerate(tables[n][0])} for n in ORDERS} if tables else {}
        self.gram_rows = {n: tables[n][1] for n in ORDERS} if tables else {}
        self.bloom: np.ndarray | None = None  # of the words in the table
        self.met: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def unseen(self, w: str) -> np.ndarray:
        for n in ORDERS:
            get = self.grams[n].get
            at = [i for i in map(get, grams(w, n)) if i is not None]
            if at:
                return self.gram_rows[n].take(at, 0).sum(0) / len(at)
        return np.zeros(len(self.langs), np.float32)

    def at(self, words: list[str]) -> list[int]:
        """Places in rows."""
        if self.rows is None or len(self.met) + len(words) > KEPT:
            self.met.clear()
        if self.rows is None or len(self.words) + len(self.met) + len(words) > len(self.rows):
            held = self.words if self.rows is None else self.rows[: len(self.words) + len(self.met)]
            self.rows = np.concatenate([held, np.zeros((max(len(held) // 2, len(words), 1000), len(self.langs)), np.float32)])
        get, met, first = self.known.get, self.met, len(self.words)
        out = []
        for w in words:
            i = get(w)
            if i is None:
                i = met.get(w)
                if i is None:
                    i = met[w] = first + len(met)
                    self.rows[i] = self.unseen(w)
            out.append(i)
        return out

    def score(self, text: str | None) -> tuple[np.ndarray | None, list[str], list[int]]:
        """Log posterior up to a constant, and the words with their counts that may be in the table."""
        found = words_of(text) if text and self.langs else None
        if not found:
            return None, [], []
        at = np.array(self.at(list(found)))
        times = np.fromiter(found.values(), np.float64, len(found))
        rows = self.prior + times @ self.rows[at]
        if self.bloom is None:
            return rows, [], []
        words = list(found)
        rest = self.listed([words[i] for i in np.nonzero(at >= len(self.words))[0]])
        return rows, rest, [found[w] for w in rest]

    def listed(self, words: list[str]) -> list[str]:
        """Those that the filter of the table's words lets pass."""
        if not words:
            return []
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(w.encode(errors="surrogatepass"), 42) for w in words), np.uint64, len(words))
        low, high = h % np.uint64(BLOOM), (h >> np.uint64(32)) % np.uint64(BLOOM)
        bit = lambda p: self.bloom[p >> np.uint64(6)] >> (p & np.uint64(63))
        return [words[i] for i in np.nonzero(bit(low) & bit(high) & np.uint64(1))[0]]


def shares(count: np.ndarray, size: np.ndarray, distinct: int) -> np.ndarray:
    """Log of each row's smoothed share in each language, relative to all languages."""
    logs = np.log((count + 0.5) / (size + 0.5 * (distinct + 1)))
    if len(logs):
        top = logs.max(1, keepdims=True)
        logs -= np.log(np.exp(logs - top).sum(1, keepdims=True)) + top
    return logs.astype(np.float32)


def counted(by: pd.Series, column: dict[str, int]) -> np.ndarray:
    """Rows of counts from lists of (lang, n)."""
    count = np.zeros((len(by), len(column)))
    for row, own in zip(count, by):
        for x in own:
            row[column[x["lang"]]] = x["n"]
    return count


def rows_of(by: DataFrame, column: dict[str, int], size: np.ndarray, distinct: int) -> DataFrame:
    """(gram, row: the bytes of its float32 log shares) of rows (gram, by)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield pd.DataFrame({"gram": part["gram"], "row": [x.tobytes() for x in shares(counted(part["by"], column), size, distinct)]})

    return by.select("gram", "by").mapInPandas(run, "gram string, row binary")


def fetched(rows: DataFrame, langs: int) -> tuple[list[str], np.ndarray]:
    """Of a bounded number of rows (gram, row), by gram."""
    found = sorted((r["gram"], bytes(r["row"])) for r in rows.collect())
    return [g for g, _ in found], np.frombuffer(b"".join(r for _, r in found), np.float32).reshape(-1, langs)


def bloom_of(words: DataFrame) -> np.ndarray:
    """Bits of the words' hashes, as Spark and Python both make them; at most BLOOM / 64 rows come to the driver."""
    h = F.xxhash64("gram")
    place = lambda x: F.pmod(x, F.lit(BLOOM))  # noqa: E731  BLOOM divides 2 ** 32, so that signs do not matter
    at = words.select(F.explode(F.array(place(h), place(F.shiftrightunsigned(h, 32)))).alias("at"))
    bits = at.groupBy(F.floor(F.col("at") / 64).alias("k")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    parts = bits.groupBy((F.col("k") % 64).alias("part")).agg(F.collect_list(F.struct("k", "bits")).alias("ks"))

    def pack(some: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in some:
            for ks in part["ks"]:
                yield pd.DataFrame({"k": [np.array([x["k"] for x in ks], np.int64).tobytes()], "bits": [np.array([x["bits"] for x in ks], np.int64).tobytes()]})

    held = np.zeros(BLOOM // 64, np.uint64)
    for r in parts.mapInPandas(pack, "k binary, bits binary").collect():  # 64 rows
        held[np.frombuffer(r["k"], np.int64)] = np.frombuffer(r["bits"], np.uint64)
    return held


def train(docs: DataFrame, cells: int = 400_000, max_grams: int = 30_000, least: int = 5) -> tuple[Model, DataFrame | None]:
    """Model of rows (text, lang), and the table (word, more: what knowing it adds) of the known words it does not hold.
    cells: numbers in the words' broadcast part, words times languages; max_grams: grams of each order; least: occurrences
    from which a word is known."""
    known = docs.select("text", "lang").filter("text is not null and lang is not null")
    languages = known.groupBy("lang").count().toPandas()
    langs = sorted(languages["lang"])
    if not langs:
        return Model([], np.zeros(0), {}), None
    prior = np.log(languages.set_index("lang").loc[langs, "count"].to_numpy(np.float64) / languages["count"].sum())
    total = lambda rows, *keys: rows.groupBy(*keys).agg(F.sum("n").alias("n"))
    by_gram = lambda rows: rows.groupBy("gram").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by"))
    words = staged(total(known.mapInPandas(_counts, "gram string, lang string, n long"), "gram", "lang"), "words")
    parts = staged(total(words.mapInPandas(_grams, "kind int, gram string, lang string, n long"), "kind", "gram", "lang"), "grams")
    column = {x: j for j, x in enumerate(langs)}
    of = lambda sizes: np.array([sizes.get(x, 0) for x in langs], np.float64)
    size = of({r["lang"]: r["n"] for r in total(words, "lang").collect()})
    table_ = staged(by_gram(words).filter(F.col("all") >= least), "known")
    distinct = table_.count()
    held = staged(most_frequent(table_, "all", max(1, cells // len(langs)), "gram"), "held")
    tables = {0: fetched(rows_of(held, column, size, distinct), len(langs))}
    sizes = {(r["kind"], r["lang"]): r["n"] for r in total(parts, "kind", "lang").collect()}
    for kind in ORDERS:
        own, in_order = by_gram(parts.filter(F.col("kind") == kind)), {x: max(sizes.get((kind, x), 0), 1) for x in langs}
        share = F.array_max(F.transform("by", lambda x: x["n"] / F.element_at(F.create_map(*(F.lit(y) for kv in in_order.items() for y in kv)), x["lang"])))  # noqa: B023
        picked = staged(most_frequent(own.withColumn("share", share * (1 << 40)), "share", max_grams, "gram"), "picked")
        tables[kind] = fetched(rows_of(picked, column, of({x: n for (k, x), n in sizes.items() if k == kind}), picked.count()), len(langs))
    model = Model(langs, prior, tables)
    if len(tables[0][0]) == distinct:
        return model, None
    rest = staged(rows_of(table_.join(held.select("gram"), "gram", "left_anti"), column, size, distinct), "rest")
    model.bloom = bloom_of(rest)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def more(some: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in some:
            yield pd.DataFrame({"word": part["gram"], "more": [np.frombuffer(r, np.float32) - shared.value.unseen(w) for w, r in zip(part["gram"], part["row"])]})

    return model, staged(rest.mapInPandas(more, "word string, more array<float>"), "rare")


def predict(docs: DataFrame, model: Model, rare: DataFrame | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of docs to keep, with lang_pred and score. Texts go no further than the first scores."""
    held, langs = docs.sparkSession.sparkContext.broadcast(model), model.langs

    @F.pandas_udf("rows array<double>, words array<string>, times array<long>")
    def start(texts: pd.Series) -> pd.DataFrame:
        found = list(zip(*map(held.value.score, texts))) or [(), (), ()]
        return pd.DataFrame({c: pd.Series([None if x is None else list(x) for x in own], dtype=object) for c, own in zip(("rows", "words", "times"), found)})

    scored = docs.withColumn("__p", start(F.col(text))).select(*keep, "__p")
    rows = F.col("__p.rows")
    if rare is not None:
        scored = staged(scored.withColumn("__row", F.monotonically_increasing_id()), "started")
        pairs = scored.select("__row", F.explode(F.arrays_zip("__p.words", "__p.times")).alias("x")).select("__row", F.col("x.words").alias("word"), F.col("x.times").alias("t"))
        found = pairs.join(rare, "word").groupBy("__row").agg(F.array(*(F.sum(F.col("t") * F.get("more", F.lit(i))) for i in range(len(langs)))).alias("__more"))
        scored = scored.select(*keep, "__row", F.col("__p.rows").alias("__rows")).join(found, "__row", "left")
        rows = F.when(F.col("__more").isNull(), F.col("__rows")).otherwise(F.zip_with("__rows", "__more", lambda a, b: a + b))
    scored = scored.withColumn("__rows", rows).withColumn("__best", F.array_max("__rows"))
    best = F.get(F.array(*map(F.lit, langs)), (F.array_position("__rows", F.col("__best")) - 1).cast("int")) if langs else F.lit(None)
    sure = 1 / F.aggregate("__rows", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__best")))
    return scored.select(*keep, F.coalesce(best, F.lit("und")).alias("lang_pred"), F.coalesce(sure, F.lit(0.0)).alias("score"))


def known_language(docs: DataFrame, model: Model, rare: DataFrame | None, least: float = 0.5) -> DataFrame:
    """docs without the rows whose text has no known language or one whose posterior is under `least`. What is decided is by
    text alone, so that only the hashes of the texts that go are joined to the rows."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    found = predict(docs.select("text", key.alias("__text")), model, rare, ["__text"])
    gone = staged(found.filter((F.col("lang_pred") == "und") | (F.col("score") < least)).select("__text").distinct(), "rejected")
    return docs.withColumn("__text", key).join(gone, "__text", "left_anti").drop("__text")


def split_fold(doc_id: Column) -> Column:
    return doc_fold(doc_id, 4) == 2


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = split_fold(F.col("doc_id"))
    model, rare = train(docs.filter(~held_out))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model, rare, ["doc_id", "held_out"])
