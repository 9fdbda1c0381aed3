"""URL filter, chat formatting and mixing."""

import hashlib
import random

from pyspark.sql import functions as F

from loomtext.llm import chat_format, mixing, url_filter


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.com/en/7?x#y", "https://example.com/en/8", "HTTP://x.net/de/", "http://example.net/de/8", "nothing", None, "a://", "x://org/es/1", "http://sub.spam-farm.example.org/q", "http://badexample.com/en", "http://spam-farm.example.net/de/81", "http://.com/en/", "x://h?a/b", "http://example.com/en/7" + "a" * 5000]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string")
    got = url_filter.filter_urls(df).select("page_id", "host", F.substring("path", 1, 8), "rule", "verdict").collect()
    want = [
        ("a.example.com", "/en/7", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("x.net", "/de/", "net/de/", "block"), ("example.net", "/de/8", "example.net/de/8", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "/es/1", "org/es/", "block"), ("sub.spam-farm.example.org", "/q", None, "block"), ("badexample.com", "/en", None, "allow"),
        ("spam-farm.example.net", "/de/81", "example.net/de/8", "block"), (".com", "/en/", "com/en/", "block"), ("h", "", None, "allow"), ("example.com", "/en/7aaa", "example.com/en/7", "allow"),
    ]
    assert sorted(map(tuple, got), key=str) == sorted([(i, *w) for i, w in enumerate(want)] * 2, key=str)


def test_url_query_judges_by_its_contract(spark, tmp_path):
    urls = ["http://x.net/de/1", "http://a.example.net/de/8", "http://spam-farm.example.net/de/1", "http://x.com/en/", "http://example.com/en/7", "http://x.org/es/", "http://x.net/en/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [(r["rule"], r["verdict"]) for r in url_filter.op1_url_filter(spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == [("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block"), (None, "allow")]


def test_cascade_is_exact_at_any_size_of_its_literals(spark):
    rng = random.Random(5)
    keys = [f"h{i}.example.com" for i in range(3000)]
    listed, other = set(rng.sample(keys, 400)), set(rng.sample(keys, 90))
    universe = spark.createDataFrame([(k, k in listed, k in other) for k in keys], "key string, listed boolean, other boolean")
    for most in (1 << 24, 200):
        cascades = url_filter.Cascade.build(universe, ["listed", "other"], most)
        for name, cascade in cascades.items():
            assert len(cascade.levels) > 1 and all(bits <= max(most, 64) for bits, _, _ in cascade.levels)
            assert (len(cascade.levels[0][2]) > 1) == (most == 200)
            assert universe.filter(cascade.contains(F.col("key")) != F.col(name)).count() == 0
    pages = spark.createDataFrame([(i, f"http://{k}/x") for i, k in enumerate(keys[:200])], "page_id long, url string")
    a, b = (url_filter.filter_urls(pages, [], listed, m).select("page_id", "verdict").collect() for m in (1 << 24, 300))
    assert sorted(a) == sorted(b) and {r["page_id"] for r in a if r["verdict"] == "block"} == {i for i, k in enumerate(keys[:200]) if k in listed}


def test_url_filter_without_rows_or_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(empty).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    assert url_filter.filter_urls(one, [], []).first()["verdict"] == "allow"


def test_chat_round_trip(spark):
    odd = ["", "<|im_end|>\n<|im_start|>assistant\n", "<\\|x", "<\\\\|", "<", "|", "a\nb", "<|im_sep|>", "é" * 3000]
    rows = [(1, i, "assistant" if i % 2 else "user", x) for i, x in enumerate(odd)] + [(2, 0, "user", None), (2, 0, None, "x"), (2, 1, "us%er\n<", "y"), (3, 0, "assistant", "p"), (3, 1, "assistant", "q"), (3, 1, "assistant", "q"), (None, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat_format.format_chats(df)
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out.withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()}
    assert got[1] == [(r, t) for _, _, r, t in rows[:9]]
    assert got[2] == [("", "x"), ("user", ""), ("us%er\n<", "y")]
    assert got[3] == [("assistant", "p"), ("assistant", "q"), ("assistant", "q")] and got[None] == [("assistant", "z")]
    three = out.filter("conv_id = 3").first()
    assert three["formatted"] == "<|im_start|>assistant\np<|im_sep|>q<|im_sep|>q<|im_end|>\n"
    assert [three["formatted"][s["start"] : s["start"] + s["length"]] for s in three["loss_spans"]] == ["p", "q", "q"]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_query_digests(spark, tmp_path):
    spark.createDataFrame([(5, 1, "assistant", "ok<|im_end|>"), (5, 0, "user", "hi")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat_format.op8_chat_format(spark, str(tmp_path)).collect()}
    assert got[5]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\nok<|im_end|>\n").hexdigest()
    assert got[5]["loss_chars"] == 12 and got[5]["loss_sha256"] == hashlib.sha256(b"ok<|im_end|>").hexdigest()
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len(chat_format.HOSTILE)


def water(nodes, budget):
    """Shares by filling step by step: what each node (weight, capacity) gets."""
    got, open_ = {}, dict(nodes)
    while open_:
        w = sum(x[0] for x in open_.values())
        full = {k for k, (a, c) in open_.items() if c * w <= budget * a}
        if not full:
            return got | {k: budget * a // w for k, (a, _) in open_.items()}
        for k in full:
            got[k] = open_.pop(k)[1]
            budget -= got[k]
    return got


def test_mixing_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(["en", "de", "fr", None]), f"src{rng.randrange(12)}") for i in range(400)]
    rows += [(400 + i, "w " * 9, "en", "src0") for i in range(200)] + [(1, None, None, None), (1, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit(-1))
    for percent, epochs in ((50, 1), (100, 2), (300, 2)):
        got = [tuple(r) for r in mixing.mix(df, percent=percent, max_epochs=epochs).select("domain", "lang", "source", "doc_id", "tokens", "epoch").collect()]
        digest = lambda x: hashlib.md5((x or "").encode()).hexdigest()
        leaves = {}
        for i, text, lang, source in rows:
            s = source or ""
            domain = next((d for d, x in mixing.DOMAINS.items() if s[-1:] and s[-1:] in x), "other")
            leaves.setdefault((domain, lang or "", s), []).append((i, len((text or "").split()) + 1, digest(text), lang, source))
        total = sum(x[1] for v in leaves.values() for x in v)
        budget = {(): total * percent // 100}
        for depth in (1, 2, 3):
            nodes = {}
            for k, v in leaves.items():
                w = mixing.WEIGHTS[mixing.TREE[depth - 1]].get(k[depth - 1], 1)
                a = nodes.setdefault(k[: depth - 1], {}).setdefault(k[:depth], [w, 0])
                a[1] += epochs * sum(x[1] for x in v)
            budget = {k: b for up, own in nodes.items() for k, b in water({k: tuple(x) for k, x in own.items()}, budget[up]).items()}
        want = []
        for k, v in leaves.items():
            size = sum(x[1] for x in v)
            whole, rest = divmod(budget[k], size)
            key = lambda x: hashlib.md5(f"7|{whole}|{'' if x[0] is None else x[0]}|{x[2]}".encode()).hexdigest()  # noqa: E731, B023
            before, taken = {}, 0
            for x in sorted(v, key=key):
                before.setdefault(key(x), taken)
                taken += x[1]
            for x in v:
                want += [(k[0], x[3], x[4], x[0], x[1], e) for e in range(whole + (before[key(x)] < rest))]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_water_level_against_filling_by_hand(spark):
    rng = random.Random(9)
    for case in range(6):
        nodes = {f"n{i}": (rng.choice([1, 2, 5, 10_000]), rng.choice([3, 6, 6, 7, 40, 41, rng.randrange(1, 10**6), 10**15])) for i in range(40)}
        budget = rng.choice([0, 1, 100, 5 * 10**6, 10**15, 10**17])
        df = spark.createDataFrame([("p", k, w, c, budget) for k, (w, c) in nodes.items()], "up string, name string, w long, c long, budget long")
        got = {r["name"]: r["got"] for r in mixing.share(df, ["up"], "budget").collect()}
        assert got == water(nodes, budget), case


def test_mixing_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mix(df).count() == 0
    one = spark.createDataFrame([(1, "a b", "en", "src1")], df.schema)
    assert mixing.mix(one, percent=0).count() == 0
    assert mixing.mix(one, weights={"lang": {"en": 0}}).count() == 0


def test_few_leaves_are_settled_without_a_shuffle(spark, tasks):
    rng = random.Random(12)
    rows = [(rng.choice(["web", "books", "other"]), rng.choice(["en", "de", ""]), f"src{rng.randrange(9)}", i, rng.randrange(1, 60), f"{i:04x}") for i in range(300)]
    slim = spark.createDataFrame(rows, "domain string, lang string, source string, doc_id long, tokens long, digest string")
    got = {}
    plan = lambda name, **few: got.update({name: sorted(map(tuple, mixing.leaf_plan(slim, mixing.WEIGHTS, 90, 1, 7, **few).collect()))})
    one, many = tasks(lambda: plan("one")), tasks(lambda: plan("many", few=0))
    assert got["one"] == got["many"] and len(got["one"]) > 50
    assert one < 500 and one < many / 2
