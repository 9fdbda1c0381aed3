"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Tokens are words, A-Z lower-cased, and an end per text. All training documents give the word counts. The `frequent`
most frequent words are classes of their own; any other word belongs to one of `groups` classes by its last three
bytes, within which it has its smoothed share of the class's count. The model predicts a token's class from the two
classes before it: score(w, h) = (C1[h1] + C2[h2]) . R[w] + b[w].

Each partition trains the model from the same start on all its training texts in numpy, with noise words shared by a
batch; the partitions' parameters are averaged by their tokens in one aggregation. The normaliser of all contexts is
one matrix product, exp(C1 R' + b) exp(C2 R')', so that every probability is normalised exactly.

A text's unigram base score needs each word's count. The `held` most frequent words are broadcast (a bound, as a
parameter); a text's other words are joined to the full table of counts, so that no count is left out.

Defined cases: a null text is empty and has the end alone; a null doc_id counts as an empty id; repeated rows are all
scored and all learned from; with nothing to learn from, every token has count 0; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_fold, most_frequent, staged, table

END, FLUSH, DIM, BATCH, NOISE = b"\n", 300_000, 16, 1024, 16  # no word holds white space


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode(errors="surrogatepass").lower().split()


def _counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: Counter = Counter()
    for part in parts:
        for text in part["text"]:
            found.update(words_of(text))
            found[END] += 1
            if len(found) > FLUSH:
                yield pd.DataFrame({"word": list(found), "c": np.fromiter(found.values(), np.int64, len(found))})
                found.clear()
    yield pd.DataFrame({"word": list(found), "c": np.fromiter(found.values(), np.int64, len(found))})


class Vocabulary:
    """The words held, most frequent first, with counts; classes of all words."""

    def __init__(self, words: list[bytes], counts: list[int], frequent: int, groups: int):
        self.index = {w: i for i, w in enumerate(words)}
        self.groups, self.frequent = groups, min(frequent, len(words))
        self.classes = self.frequent + groups
        self.begin = self.classes
        self.of = np.array([i if i < self.frequent else self.group(w) for i, w in enumerate(words)], np.int64)
        self.log_count = np.log10(np.array(counts, np.float64) + 1)
        self.end = self.index.get(END, -1)

    def group(self, word: bytes) -> int:
        return self.frequent + zlib.crc32(word[-3:]) % self.groups

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Index of each token or -1, its class, and the words that are not held."""
        words = words_of(text)
        words.append(END)
        get = self.index.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        classes = self.of[at] if len(self.of) else np.zeros(len(at), np.int64)
        new = [words[i] for i in np.nonzero(at < 0)[0]]
        classes[at < 0] = [self.group(w) for w in new]
        return at, classes, new


class LogBilinear:
    def __init__(self, noise: np.ndarray, seed: int = 1):
        """noise: the classes' shares."""
        rng = np.random.default_rng(seed)
        k = len(noise)
        self.noise, self.bias = noise, np.log(noise).astype(np.float32)
        self.c1, self.c2 = (rng.normal(0, 0.3, (k + 1, DIM)).astype(np.float32) for _ in range(2))
        self.r = np.zeros((k, DIM), np.float32)  # the start is the unigram model
        self.rng, self.cumulative = rng, np.cumsum(noise)
        self.grown = [np.full(x.shape, 1e-2, np.float32) for x in (self.c1, self.c2, self.r, self.bias)]

    def step(self, h1: np.ndarray, h2: np.ndarray, w: np.ndarray, rate: float) -> None:
        """One batch of noise-contrastive estimation with AdaGrad."""
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), len(self.noise) - 1)
        own = np.log(NOISE * self.noise).astype(np.float32)
        q = self.c1[h1] + self.c2[h2]
        rw, rn = self.r[w], self.r[drawn]
        good = 1 / (1 + np.exp(-np.clip((q * rw).sum(1) + self.bias[w] - own[w], -30, 30))) - 1
        bad = 1 / (1 + np.exp(-np.clip(q @ rn.T + self.bias[drawn] - own[drawn], -30, 30)))
        dq = good[:, None] * rw + bad @ rn
        spread = lambda at, g, n: np.bincount((at[:, None] * DIM + np.arange(DIM)).ravel(), g.ravel(), n * DIM).reshape(n, DIM)
        dr = spread(w, good[:, None] * q, len(self.r))
        np.add.at(dr, drawn, bad.T @ q)
        db = np.bincount(w, good, len(self.bias))
        np.add.at(db, drawn, bad.sum(0))
        for x, seen, g in zip((self.c1, self.c2, self.r, self.bias), self.grown, (spread(h1, dq, len(self.c1)), spread(h2, dq, len(self.c2)), dr, db)):
            g = (g / len(w)).astype(np.float32)
            seen += g * g
            x -= rate * g / np.sqrt(seen)

    def rows(self) -> np.ndarray:
        return np.concatenate([self.c1, self.c2, self.r, np.pad(self.bias[:, None], ((0, 0), (0, DIM - 1)))])

    def load(self, rows: np.ndarray) -> None:
        k = len(self.r)
        self.c1, self.c2, self.r, bias = np.split(rows, [k + 1, 2 * k + 2, 3 * k + 2])
        self.bias = bias[:, 0]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of P(w | h1, h2) = first[h1, w] + second[h2, w] - norm[h1, h2]."""
        first, second = self.c1 @ self.r.T + self.bias, self.c2 @ self.r.T
        a, b = first.max(1, keepdims=True), second.max(1, keepdims=True)
        norm = np.log(np.maximum(np.exp(first - a) @ np.exp(second - b).T, 1e-300)) + a + b.T
        return tuple((x / math.log(10)).astype(np.float32) for x in (first, second, norm))


def contexts(classes: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    h1 = np.concatenate([[begin], classes[:-1]])
    return h1, np.concatenate([[begin], h1[:-1]])


def _train(vocabulary, noise: np.ndarray, rate: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, model = vocabulary.value, LogBilinear(noise)
        waiting, held, seen = [], 0, 0

        def learn(last: bool) -> None:
            nonlocal waiting, held, seen
            h1, h2, w = (np.concatenate(x) for x in zip(*waiting))
            upto = len(w) if last else len(w) // BATCH * BATCH
            for a in range(0, upto, BATCH):
                model.step(h1[a : a + BATCH], h2[a : a + BATCH], w[a : a + BATCH], rate)
            waiting, held, seen = [(h1[upto:], h2[upto:], w[upto:])], len(w) - upto, seen + upto

        for part in parts:
            for text in part["text"]:
                _, classes, _ = v.encode(text)
                waiting.append((*contexts(classes, v.begin), classes))
                held += len(classes)
                if held >= 64 * BATCH:
                    learn(False)
        if held:
            learn(True)
        if seen:
            rows = model.rows().astype(np.float64)
            yield pd.DataFrame({"row": np.arange(len(rows)), "n": seen} | {f"p{i}": rows[:, i] * seen for i in range(DIM)})

    return run


class Scorer:
    """What a worker needs to score a text up to the words that are not held."""

    def __init__(self, v: Vocabulary, tables: tuple, total: int, distinct: int, group_size: np.ndarray):
        """group_size: of each class, 1 for frequent words and else the class's count, types and one."""
        self.v, self.tables, self.unit, self.log_size = v, tables, math.log10(total + distinct + 1), np.log10(group_size)

    def __call__(self, text: str | None) -> tuple:
        v, (first, second, norm) = self.v, self.tables
        at, classes, new = v.encode(text)
        h1, h2 = contexts(classes, v.begin)
        logs = np.where(at >= 0, v.log_count[at], 0.0) if len(v.log_count) else np.zeros(len(at))
        known = first[h1, classes].astype(np.float64) + second[h2, classes] - norm[h1, h2]
        tail = classes >= v.frequent
        score = known.sum() + (logs - self.log_size[classes])[tail].sum()
        found = Counter(new)
        return len(at), int((at >= 0).sum()), float(logs.sum() - len(at) * self.unit), float(score), list(found), list(found.values())


def _score(scorer):
    names = ["n_tokens", "n_known", "base_score", "score", "words", "times"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, row = scorer.value, TaskContext.get().partitionId() << 33
        for part in parts:
            for a in range(0, len(part), 2000):
                some = part.iloc[a : a + 2000]
                out = pd.DataFrame(map(of, some["text"]), columns=names)
                out.insert(0, "row", np.arange(row, row + len(some)))
                row += len(some)
                for c in ("doc_id", "held_out"):
                    out[c] = some[c].to_numpy()
                yield out

    return run


class Fitted:
    """What was learned: the model, the held vocabulary, all words' counts and the classes' sizes."""

    def __init__(self, model: LogBilinear, vocabulary: Vocabulary, counts: DataFrame, total: int, distinct: int, size: np.ndarray):
        """size: of each class, its words' counts and one for each word and for the unknown one; 1 for frequent words."""
        self.model, self.vocabulary, self.counts, self.total, self.distinct, self.size = model, vocabulary, counts, total, distinct, size


def fit(training: DataFrame, frequent: int = 1024, groups: int = 512, held: int = 200_000, rate: float = 0.5) -> Fitted:
    """Learns from all rows (text)."""
    # the bytes of a word are UTF-8, as its text's were
    counts = staged(training.mapInPandas(_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = sorted(most_frequent(counts, "c", held, "word").collect(), key=lambda r: (-r["c"], bytes(r["word"])))
    v = Vocabulary([bytes(r["word"]) for r in top], [r["c"] for r in top], frequent, groups)
    last = F.crc32(F.expr("substring(word, greatest(length(word) - 2, 1), 3)"))
    rest = {r["g"]: (r["c"], r["n"]) for r in counts.groupBy(F.pmod(last, F.lit(groups)).cast("int").alias("g")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    size = np.ones(v.classes)
    for g, (c, n) in rest.items():
        size[v.frequent + g] += c + n
    for r in top[: v.frequent]:
        size[v.group(bytes(r["word"]))] -= r["c"] + 1
    share = np.concatenate([[r["c"] for r in top[: v.frequent]], size[v.frequent :]])
    noise = share / share.sum()
    words = training.sparkSession.sparkContext.broadcast(v)
    model = LogBilinear(noise)
    learned = training.mapInPandas(_train(words, noise, rate), "row int, n long, " + ", ".join(f"p{i} double" for i in range(DIM)))
    mean = learned.groupBy("row").agg(*(F.sum(f"p{i}") / F.sum("n") for i in range(DIM))).collect()  # as many rows as the model has
    if mean:
        model.load(np.array([r[1:] for r in sorted(mean)]))
    return Fitted(model, v, counts, int(total), int(distinct), size)


def score_texts(docs: DataFrame, held_out: Column, frequent: int = 1024, groups: int = 512, held: int = 200_000, rate: float = 0.5, fitted: Fitted | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    fitted = fitted or fit(rows.filter(~F.col("held_out")).select("text"), frequent, groups, held, rate)
    v, counts, total = fitted.vocabulary, fitted.counts, fitted.total
    scorer = spark.sparkContext.broadcast(Scorer(v, fitted.model.tables(), total, fitted.distinct, fitted.size))
    schema = "row long, n_tokens long, n_known long, base_score double, score double, words array<binary>, times array<long>, doc_id long, held_out boolean"
    part = staged(rows.mapInPandas(_score(scorer), schema), "scores")
    pairs = part.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("t"))
    found = pairs.join(counts, "word").groupBy("row").agg(F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("more"), F.sum("t").alias("known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return part.drop("words", "times").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero(F.col("known"))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero(F.col("more"))).alias("base_score"), (F.col("score") + zero(F.col("more"))).alias("score"),
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), doc_fold(F.col("doc_id"), 7) == 2)
