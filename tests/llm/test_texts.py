"""Fingerprints, packing, language models, language identification, main text and the pipeline."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import html_template, langid, lm, packing, simhash
from loomtext.llm.common import doc_fold, most_frequent

SCHEMA = "doc_id long, text string, lang string, source string"
ODD = [None, "", "  \t\n", "one", "two words", "ÀB ab", "x" * 20000, "a b c " * 5000, "12 34 !?", "<|endoftext|> b"]


def corpus(n=120, seed=0):
    rng = random.Random(seed)
    words = {"en": "the of and ing tion".split(), "de": "der die und ung keit".split(), "fr": "le la et eau ment".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "", "s", "xq"]) for _ in range(rng.randrange(20, 80))), lang, f"src{i % 7}"))
    for i in range(30):
        rows.append((n + i, rows[i % 3][1], rows[i % 3][2], "src0"))
    rows += [(n + 30 + i, t, "en", None) for i, t in enumerate(ODD)]
    return rows + [rows[5], (None, "no id", None, None), (None, None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("clash"), "fp": F.lit(1), "row": F.lit(2), "prompt": F.lit(3)})


def fold_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_fingerprint(text, k):
    w = fold_words(text)
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def reach(values, near):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if near(values[i], values[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_fingerprints_and_components(spark):
    rows = corpus()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = [brute_fingerprint(t, 3) for _, t, _, _ in rows]
    assert Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in got) == Counter((x[0], p) for x, p in zip(rows, prints))
    roots = reach(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for x, r in zip(rows, roots):
        if x[0] is not None:
            least[r] = min(least.get(r, x[0]), x[0])
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((x[0], least.get(r)) for x, r in zip(rows, roots))
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("budget, most", [(2, 20), (2, 1000), (3, 9)])
def test_trie_join_finds_every_link(spark, budget, most):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = list({b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(12)})
    rows = [(v - (1 << 64) if v >> 63 else v, v.to_bytes(8, "little"), 0) for v in values]
    df = spark.createDataFrame(rows, "id long, fp binary, class int")
    edges = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.links(df, budget, budget + 1, most=most).collect()]
    near = lambda a, b: (a ^ b).bit_count() <= budget
    want = reach(values, near)
    at = {v: i for i, v in enumerate(values)}
    got = reach(values, lambda a, b, own=set(edges): (a, b) in own or (b, a) in own)
    group = lambda roots: sorted(sorted(values[i] for i in range(len(values)) if roots[i] == r) for r in set(roots))
    assert len(at) == len(values) and group(got) == group(want)


def test_wide_tries_meet_by_class_and_budget(spark):
    """Two words, two tries of 24 bits in which one may differ; classes one apart meet, others do not."""
    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(30)]
    values = [(b ^ sum(1 << i for i in rng.sample(range(128), rng.randrange(7))), rng.randrange(4)) for b in base for _ in range(8)]
    rows = [(i, v.to_bytes(16, "little"), c) for i, (v, c) in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, fp binary, class int")

    def near(x, y):
        blocks = [((x[0] ^ y[0]) >> a & 0xFFFFFF).bit_count() <= 1 for a in (0, 24)]
        return abs(x[1] - y[1]) <= 1 and any(blocks) and (x[0] ^ y[0]).bit_count() <= 8

    want = reach(values, near)
    for most in (10, 10**6):
        edges = {(r["u"], r["v"]) for r in simhash.links(df, 8, 2, 24, 1, most=most).collect()}
        assert reach(list(range(len(values))), lambda a, b, own=edges: (a, b) in own or (b, a) in own) == want


def test_walk_against_all_pairs():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 12, 500).astype(np.uint64) << np.uint64(52))
    b = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64) << np.uint64(52))
    found = {(int(x), int(y)) for p, q in simhash.walk(a, b, False, 2, small=4) for x, y in zip(p, q)}
    assert found == {(i, j) for i, j in itertools.product(range(len(a)), range(len(b))) if int(a[i] ^ b[j]).bit_count() <= 2}
    own = [(int(x), int(y)) for p, q in simhash.walk(a, a, True, 1, small=4) for x, y in zip(p, q)]
    assert len(own) == len(set(own)) and {tuple(sorted(x)) for x in own} == {(i, j) for i, j in itertools.combinations(range(len(a)), 2) if int(a[i] ^ a[j]).bit_count() <= 1}


def check_pieces(pieces, wanted, tokens=2048):
    """wanted: ids by doc_id."""
    by, sequences = {}, {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(by) == set(wanted)
    for d, own in by.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(wanted[d])
            assert r["ids_crc32"] == zlib.crc32(np.asarray(wanted[d][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(wanted[d])
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= tokens
        padding += 0 if at & (at - 1) == 0 else tokens - at
    return sequences, padding


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r for r in corpus() if r[0] is not None][:-1]
    wanted = {i: [*known.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _, _ in rows}
    pieces = packing.pack(frame(spark, rows).repartition(3)).collect()
    _, padding = check_pieces(pieces, wanted)
    assert padding == 0
    assert packing.pack(frame(spark, rows).limit(0)).count() == 0
    assert packing.pack(frame(spark, [(None, None, None, None)] * 2)).count() == 2


def test_packer_keeps_all_limits():
    rng = random.Random(8)
    for _ in range(15):
        p = packing.Packer(tokens=100, segments=4, loss=60)
        lengths = [rng.choice([1, 5, 30, 90, 250]) for _ in range(60)]
        items = [[i, 0, n, rng.randrange(n + 1)] for i, n in enumerate(lengths)]
        prompts = [x[3] for x in items]
        pieces = list(p.pack(items[:40])) + list(p.pack(items[40:]))
        by, sequences = {}, {}
        for e, a, n, s, o, loss in pieces:
            by.setdefault(e, []).append((a, n))
            sequences.setdefault(s, []).append((o, n, loss))
            assert loss == max(0, a + n - max(a, prompts[e]))
        for e, own in by.items():
            assert [a for a, _ in sorted(own)] == [0, *itertools.accumulate(n for _, n in sorted(own))][:-1] and sum(n for _, n in own) == lengths[e]
        assert len(by) == 60
        for own in sequences.values():
            assert sum(n for _, n, _ in own) <= 100 and len(own) <= 4 and sum(x for *_, x in own) <= 60


def test_language_model_counts_and_normalisation(spark):
    rows = [r for r in corpus() if r[0] is not None][:-1]
    got = {r["doc_id"]: r for r in lm.score_texts(frame(spark, rows), doc_fold(F.col("doc_id"), 7) == 2, frequent=12, groups=4, held=20).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    tokens = {i: [*fold_words(t), "\n"] for i, t, _, _ in rows}
    c = Counter(w for i, own in tokens.items() if not out[i] for w in own)
    n, v = sum(c.values()), len(c)
    for i, own in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
        assert r["score"] < 0
    share = np.array([0.5, 0.3, 0.2])
    model = lm.LogBilinear(share)
    for _ in range(50):
        model.step(*np.random.default_rng(1).integers(0, 3, (3, 64)), 0.3)
    first, second, norm = model.tables()
    total = np.power(10.0, first[:, None, :].astype(float) + second[None, :, :] - norm[:, :, None]).sum(2)
    assert np.allclose(total, 1, atol=1e-4)
    start = lm.LogBilinear(share).tables()
    assert np.allclose(np.power(10.0, start[0][0] + start[1][0] - start[2][0, 0]), share, atol=1e-5)


def test_language_model_scores_by_hand(spark):
    """The score is the sum of log10 P(class | two classes before) + log10 P(word | class), over all words and the end."""
    rows = [r for r in corpus(60, 4) if r[0] is not None][:-1] + [(500, None, None, None), (501, "unseen wordsxyz here", "en", None), (501, "unseen wordsxyz here", "en", None), (None, "no id", None, None)]
    df = frame(spark, rows)
    fitted = lm.fit(df.filter("doc_id < 40").select("text"), frequent=8, groups=3, held=12)
    got = [(r["doc_id"], r["score"]) for r in lm.score_texts(df, F.col("doc_id") >= 40, fitted=fitted).collect()]
    c = Counter({bytes(r["word"]).decode(): r["c"] for r in fitted.counts.collect()})
    frequent = [w.decode() for w in sorted(fitted.vocabulary.index, key=fitted.vocabulary.index.get)[:8]]
    group = lambda w: 8 + zlib.crc32(w.encode()[-3:]) % 3
    of = lambda w: frequent.index(w) if w in frequent else group(w)
    size = Counter()
    for w, n in c.items():
        if w not in frequent:
            size[group(w)] += n + 1
    m, want = fitted.model, []
    for i, t, _, _ in rows:
        before, total = [11, 11], 0.0
        for w in [*fold_words(t), "\n"]:
            logits = [(m.c1[before[1]] + m.c2[before[0]]) @ m.r[k] + m.bias[k] for k in range(11)]
            k = of(w)
            total += (logits[k] - math.log(sum(math.exp(x) for x in logits))) / math.log(10) + (math.log10((c[w] + 1) / (size[k] + 1)) if k >= 8 else 0)
            before = [before[1], k]
        want.append((i, total))
    key = lambda x: (x[0] is None, x[0], x[1])
    assert [i for i, _ in sorted(got, key=key)] == [i for i, _ in sorted(want, key=key)]
    assert [s for _, s in sorted(got, key=key)] == pytest.approx([s for _, s in sorted(want, key=key)], rel=1e-4)


def test_language_model_learns_word_order(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(w for _ in range(60) for w in rng.choice([("a", "b", "c"), ("d", "e", "f")])), "en", None) for i in range(200)]
    got = lm.score_texts(frame(spark, rows), doc_fold(F.col("doc_id"), 7) == 2).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]


def test_language_model_edges(spark):
    assert lm.score_texts(frame(spark, []), F.lit(False)).count() == 0
    r = lm.score_texts(frame(spark, [(1, "a b", None, None)]), F.lit(True)).first()
    assert (r["n_known"], r["train_tokens"], r["n_tokens"], r["base_score"]) == (0, 0, 3, 0.0)


def test_language_identification(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).drop("id", "fp", "row", "prompt").write.parquet(str(tmp_path / "documents.parquet"))
    got = langid.op9_langid(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {i: (t, lang) for i, t, lang, _ in rows if i is not None}
    own = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 150]
    assert sum(r["lang_pred"] == truth[r["doc_id"]][1] for r in own if r["held_out"]) >= 0.95 * sum(r["held_out"] for r in own)
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
            assert (r["lang_pred"] == "und") == (not any(ch.isalpha() for ch in truth[r["doc_id"]][0] or ""))


def test_backoff_goes_from_words_to_shorter_grams():
    rows = lambda *x: np.log(np.array(x, np.float32))
    tell = lambda m, text: [m.langs[int(r.argmax())] for r, _, _ in [m.score(text)]][0]
    tables = {0: (["ab"], rows([0.9, 0.1])), 4: (["<xyz"], rows([0.2, 0.8])), 3: ([], np.zeros((0, 2), np.float32)), 2: (["<x"], rows([0.7, 0.3])), 1: (["q"], rows([0.4, 0.6]))}
    m = langid.Model(["a", "b"], np.log([0.5, 0.5]), tables)
    assert tell(m, "ab") == "a" and tell(m, "xyzz") == "b" and tell(m, "xa") == "a" and tell(m, "q") == "b"
    assert m.score("ab xyzz xyzz")[1:] == ([], []) and langid.Model([], np.zeros(0), {}).score("word") == (None, [], [])


def test_language_scores_by_a_recount(spark):
    """Few broadcast words: the others come from the table; grams of all words."""
    rows = [(i, t, lang, s) for i, (_, t, lang, s) in enumerate(corpus(60, 2))]
    df = frame(spark, rows)
    model, rare = langid.train(df, cells=9, max_grams=1 << 20, least=1)
    assert rare.count() > 0 and len(model.known) <= 3
    got = {r["doc_id"]: r for r in langid.predict(df, model, rare, ["doc_id"]).collect()}
    words = lambda t: [w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()]
    langs = sorted({lang for _, t, lang, _ in rows if t is not None and lang is not None})
    per = {x: Counter(w for _, t, lang, _ in rows if lang == x for w in words(t)) for x in langs}
    docs = Counter(lang for _, t, lang, _ in rows if t is not None and lang is not None)
    distinct = len(set().union(*per.values()))
    share = lambda w, x: math.log((per[x][w] + 0.5) / (sum(per[x].values()) + 0.5 * (distinct + 1)))
    for i, t, _, _ in rows:
        found = [w for w in words(t) if any(w in own for own in per.values())]
        if len(found) != len(words(t)) or not found:
            continue
        logs = {}
        for x in langs:
            logs[x] = math.log(docs[x] / sum(docs.values())) + sum(share(w, x) - math.log(sum(math.exp(share(w, y)) for y in langs)) for w in found)
        best = max(logs, key=logs.get)
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel=1e-4)


def test_language_needs_letters(spark):
    rows = [(i, t, "en", None) for i, t in enumerate(["²", "Ⅷ ½ ①", "٣٤", "_", "é", "字", "a²"])] + [(9, "some words", "en", None), (9, "some words", "en", None)]
    df = frame(spark, rows)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(df, *langid.train(df), ["doc_id"]).collect()]
    assert sorted(got) == [(0, "und"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en"), (6, "en"), (9, "en"), (9, "en")]
    kept = langid.known_language(df, *langid.train(df))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 9, 9]
    none = df.limit(0)
    assert langid.predict(none, *langid.train(none), ["doc_id"]).count() == 0 and {r["lang_pred"] for r in langid.predict(df, *langid.train(none), ["doc_id"]).collect()} == {"und"}


def test_most_frequent_is_bounded(spark):
    df = spark.range(1, 500).select("id", (F.col("id") % 50 + 1).alias("n"))
    kept = [r["n"] for r in most_frequent(df, "n", 100, "id").collect()]
    assert 80 <= len(kept) <= 100 and min(kept) > 35
    assert most_frequent(df, "n", 0, "id").count() == 0
    tied = spark.range(300).withColumn("n", F.lit(1))
    assert 190 <= most_frequent(tied, "n", 200, "id").count() <= 200 and most_frequent(tied, "n", 300, "id").count() == 300


def jaccard(a, b, k=5):
    cut = lambda t: {tuple(w[i : i + k]) for w in [t.lower().split()] for i in range(max(1, len(w) - k + 1))}
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b))


def test_repeated_common_line_is_no_near_duplicate(spark):
    rng = random.Random(5)
    line = " ".join(f"common{i}" for i in range(14))
    texts = [" ".join([line] * 10 + [f"own{k}x{rng.randrange(10**6)}" for _ in range(100)]) for k in range(12)]
    assert max(jaccard(a, b) for a, b in itertools.combinations(texts, 2)) < 0.2
    got = simhash.similar(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    assert all(r["doc_id"] == r["component_id"] for r in got) and len(got) == 12


def test_near_duplicates_are_all_found(spark):
    rng, texts = random.Random(6), []
    for k in range(40):  # exactly 0.8: 8 of 10 shingles, by words at the end
        base = [f"w{k}x{i}" for i in range(13)]
        texts += [" ".join(base), " ".join(base[:12] + [f"z{k}"]), " ".join(base[:8])]
    for k in range(20):  # sets of 4 and 5, of 12 and 15 shingles
        base = [f"s{k}x{i}" for i in range(19)]
        texts += [" ".join(base[:9]), " ".join(base[1:9]), " ".join(base), " ".join(base[:16])]
    for k in range(6):  # one set of shingles, one text with a line many times; and a dense group
        line, own = [f"l{k}x{i}" for i in range(10)], [f"o{k}x{i}" for i in range(60)]
        texts += [" ".join(own + line * 2), " ".join(own + line * 12)]
        texts += [" ".join(own[:i] + ["edit"] + own[i + 1 :]) for i in range(0, 60, 6)]
    rng.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    roots = reach(texts, lambda a, b: jaccard(a, b) >= 0.8)
    assert [got[i] for i in range(len(texts))] == roots


def test_near_duplicate_recall_just_above_the_threshold(spark):
    """Pairs between 0.8 and 0.85 of 20 to 3000 words, and pairs just below 0.8 that must stay."""
    rng, texts, pairs = random.Random(11), [], []
    for k in range(400):
        n = rng.choice([20, 40, 100, 300, 1000, 3000]) if k % 40 == 0 else rng.choice([20, 40, 80, 150, 300])
        words = [f"w{k}x{i}" for i in range(n)]
        cut, below = rng.randrange(int(0.15 * n), int(0.21 * n) + 2), k % 4 == 3
        other = words[: n - cut] if not below else words[: n - int(0.24 * n)]
        j = jaccard(" ".join(words), " ".join(other))
        if 0.8 <= j < 0.87 or below and j < 0.8:
            pairs.append((len(texts), len(texts) + 1, j))
            texts += [" ".join(words), " ".join(other)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    above, under = [got[a] == got[b] for a, b, j in pairs if j >= 0.8], [got[a] == got[b] for a, b, j in pairs if j < 0.8]
    assert len(above) >= 150 and len(under) >= 80 and not any(under) and sum(above) >= 0.99 * len(above)


def test_clusters_beyond_a_task_are_settled_whole(spark):
    rng, texts = random.Random(12), []
    for k in range(3):
        base = [f"b{k}x{i}" for i in range(60)]
        texts += [" ".join(base[:i] + [f"e{i}"] + base[i + 1 :]) for i in range(0, 60, 2)] + [" ".join(base), " ".join(base[:52])]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), most=500).collect()}
    assert [got[i] for i in range(len(texts))] == reach(texts, lambda a, b: jaccard(a, b) >= 0.8)


def test_one_document_of_each_group_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(5, a, "en", "s"), (3, a + " x", "en", "s"), (None, a, "en", "s"), (7, b, "en", "s"), (7, b, "en", "s"), (7, a + " y z", "en", "s"), (8, "other words", "en", "s"), (8, "not these", "en", "s"), (9, None, "en", "s"), (None, " ", None, None), (None, "lone", None, None), (None, "lone", None, None)]
    df = frame(spark, rows)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(3, a + " x"), (7, b), (8, "other words"), (8, "not these"), (9, None), (None, "lone")], key=str)
    assert simhash.one_of_each(df.limit(0)).count() == 0


def page(i, body, host="a.example.com", extra=""):
    return (i, f"https://{host}/en/{i}", f"<html><head><title>t{i}</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/x'>menu {i}</a></li></ul></nav><div class='ad'>buy {i}</div>{extra}<article><h1>Title {i}</h1>{body}</article><div id='comments'><p>reader {i} says</p></div><footer>&copy; {i}</footer></body></html>")


def test_main_text(spark):
    bodies = [f"<p>First  {i}&amp;\n&eacute;<br>x</p><p>Second <b>bo</b>ld {i}<p>Third {i}" for i in range(12)]
    rows = [page(i, b) for i, b in enumerate(bodies)] + [page(20, "<p>copy</p>", "b.example.com"), page(21, "<p>copy</p>", "b.example.com"), (30, "no host", "<p>only"), (31, None, None), (32, "http://c/", ""), (33, "http://c/", "<div><p>unclosed <i>x"), (34, "http://d/", "a" * 30000)]
    rows += [page(40 + i, "<form><input></form><p>real {0} text</p><aside>side</aside>".format(i), "c.example.com", "<div><p>Same words on every page</p></div>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_template.extract_text(df).collect()}
    for i in range(12):
        assert got[i]["text"] == f"Title {i}\n\nFirst {i}& é x\n\nSecond bold {i}\n\nThird {i}"
    assert got[20]["text"] == "Title 20\n\ncopy" and got[30]["text"] == "only" and got[31]["text"] == "" and got[32]["text"] == ""
    assert got[33]["text"] == "unclosed x" and got[34]["n_chars"] == 30000
    assert all(got[40 + i]["text"] == f"Title {40 + i}\n\nreal {i} text" for i in range(6))
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and got[5]["url"] == rows[5][1]
    assert html_template.extract_text(df.limit(0)).count() == 0


PAGES = "page_id long, url string, html string"


def neutral(i, n=40):
    """No element or class says what it is: a menu, an advert, a page's own text, readers' words, an imprint of two kinds."""
    own = "".join(f"<p>own words {i} {j} of this page and no other one</p>" for j in range(3 + i % 4))
    return (i, "http://h.example/x", f"<html><body><div class='x1'><ul><li>Home<li>Shop<li>Help</ul></div><div class='x2'>offer {i} today</div><div class='x5'><h2>Name {i}</h2>{own}<p>Read more on our site</p></div><div class='x3'>Imprint {i % 2}</div></body></html>")


def test_template_alone_tells_main_text(spark):
    rows = [neutral(i) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in html_template.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(20):
        assert got[i] == "\n\n".join([f"Name {i}", *(f"own words {i} {j} of this page and no other one" for j in range(3 + i % 4))])
        bare = html_template.main_text(rows[i][2], None, set(), set())
        assert "Home" in bare and "Imprint" in bare and "offer" in bare and "Read more" in bare  # what the template takes away
    alone = html_template.extract_text(spark.createDataFrame(rows[:1], PAGES)).first()
    assert alone["text"] == html_template.main_text(rows[0][2], None, set(), set())


def test_copies_on_one_host_stay_text(spark):
    body = "<div class='a'><p>The same article again and again</p><p>and its second part</p></div>"
    rows = [(i, "http://h.example/x", f"<html><body>{body}</body></html>") for i in range(9)]
    rows += [(20 + i, "http://g.example/x", f"<html><body><div class='a'><p>{'one article copied over' if i < 5 else f'own article {i} of some length'}</p></div></body></html>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_template.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert {got[i] for i in range(9)} == {"The same article again and again\n\nand its second part"}
    assert [got[20 + i] for i in range(12)] == ["one article copied over"] * 5 + [f"own article {i} of some length" for i in range(5, 12)]


def test_slots_against_a_plain_deduction(spark):
    """The same template from vectors that are written out, for hosts of random layouts."""
    rng = random.Random(3)
    rows = []
    for h in range(6):
        parts = rng.sample(["<div class='m'><b>menu</b></div>", "<div class='t'><p>{own}</p><p>{more}</p></div>", "<section><p>{own} x</p></section>", "<footer>foot</footer>", "<div class='k'>{two}</div>"], rng.randrange(2, 6))
        for i in range(rng.choice([2, 7, 30])):
            own = {"own": f"text {h} {i} " + "w " * rng.randrange(30), "more": f"more {h} {i}", "two": f"kind {i % 2}"}
            rows.append((len(rows), f"http://h{h}.example/", "<html><body>" + "".join(p.format(**own) for p in parts if rng.random() > 0.05) + "</body></html>"))
    got = {r["page_id"]: r["text"] for r in html_template.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    for h in range(6):
        pages = [(i, html_template.page_tokens(x)) for i, u, x in rows if u == f"http://h{h}.example/"]
        n, vectors = len(pages), {}
        for i, tokens in pages:
            for k, (c, chars, listed) in tokens.items():
                vectors.setdefault(k, []).append((i, c, chars, listed))
        total = lambda k, at, v=vectors: sum(x[at] for x in v[k])
        repeated = Counter()
        for (p, t), v in vectors.items():
            if t is not None and len(v) >= max(3, 0.05 * n):
                repeated[p] += sum(x[2] for x in v)
        tokens = [(p, t, tuple(x[:2] for x in v), len(v), total((p, t), 1), total((p, t), 2), total((p, t), 3), 0 if t is not None else repeated[p]) for (p, t), v in vectors.items() if len(v) >= (0.5 if t is None else 0.9) * n and (len(v) > 1 or p == "")]
        main, still, texts = html_template.deduce(tokens, n)
        for i, u, x in rows:
            if u == f"http://h{h}.example/":
                assert got[i] == html_template.main_text(x, main, set(still), set(texts))


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    rows = corpus()
    base = " ".join(f"unique{i}" for i in range(300)).split()
    for i in range(6):
        w = list(base)
        w[rng.randrange(300)] = f"edit{i}"
        rows.append((900 + i, " ".join(w), "en", "src1"))
    df = frame(spark, rows)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    kept = df
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        sizes.append(kept.count())
        if name != "packing":
            assert kept.columns == df.columns
    ids = lambda name: [r["doc_id"] for r in spark.read.parquet(str(tmp_path / name)).select("doc_id").collect()]
    spoken = Counter(ids("language_id"))
    texts = {i: t for i, t, _, _ in rows if i is not None}
    gone = {i for i in texts if spoken[i] == 0}
    assert gone >= {i for i, t in texts.items() if not any(ch.isalpha() for ch in t or "")} and all(150 <= i < 160 for i in gone)
    left = Counter(ids("near_dedup"))
    assert max(v for k, v in left.items() if k is not None) == 1
    assert not any(left[120 + i] for i in range(30)) and left[0] and left[1] and left[2]
    assert sum(left[900 + i] for i in range(6)) == 1 and all(left[i] for i in range(3, 60))
    assert sizes[2] <= sizes[1] and set(ids("packing")) == set(ids("mixing"))
    frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_few_links_are_joined_up_by_one_task(spark, tasks):
    rng = random.Random(11)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7)]
    edges = spark.createDataFrame(pairs * 2, "u long, v long")
    root = {x: x for p in pairs for x in p}
    while any(root[a] != root[b] for a, b in pairs):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = sorted((v, r) for v, r in root.items() if v != r)
    got = []
    assert tasks(lambda: got.extend(tuple(r) for r in simhash.components(edges).select("v", "root").collect())) < 50
    assert sorted(got) == want
    assert sorted(tuple(r) for r in simhash.components(edges, most=10).select("v", "root").collect()) == want
    assert simhash.components(edges.limit(0)).count() == 0
