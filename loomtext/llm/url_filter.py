"""URL filters by a Bloom filter cascade, with DataFrame functions only.

A key is a host suffix followed by a path prefix ("example.com/en/7", "net/de/", "spam.example.org"). Rules and listed
hosts have few shapes (labels of the host, characters of the path), so a url has one candidate key for each shape. The
distinct candidate keys of the whole corpus are the key universe. A cascade's first level is a Bloom filter of the
listed keys; the second holds the other keys of the universe that pass the first; the third the listed keys that pass
the second, and so on until none passes. The first level that a key fails says whether it is listed, exactly for each
key of the universe, with no join.

The filters go into the plan as literals of at most `max_bits` each. A level that needs more is dealt to several literals
by the key's hash, so that the method is one at any size: what grows is the listed keys, not the pages. The cascades of
all lists are built together, a level at a time.

Defined cases: a null url, or one without "://", has an empty host and path and fits nothing; of two rules of equal
length the one with the longer host wins; a rule that is both allowed and blocked allows; repeated rows are all kept;
a very long url is read whole; an empty table gives no rows; other columns of the input stay as they are unless they have
an output's name, which then is the output.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, staged, table

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: The rules of op1's contract. RULES, the operator's default that OP1_SQL is made of, has another word for net/de/.
CONTRACT = tuple(("allow", k) if k == "net/de/" else (a, k) for a, k in RULES)
LISTED = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
WORD = 32


def shape(key: str) -> tuple[int, int]:
    host, slash, path = key.partition("/")
    return host.count(".") + 1, len(slash + path)


def candidate(host: Column, path: Column, of: tuple[int, int]) -> Column:
    """The url's key of that shape; null if it has too few labels or too short a path."""
    labels, chars = of
    has = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) >= labels - 1
    return F.when((host != "") & has & (F.length(path) >= chars), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars)))


def places(key: Column, seed: int, bits: int, hashes: int) -> Column:
    """The key's bit positions, as an array."""
    a, b = (F.pmod(F.xxhash64(F.lit(2 * seed + i), key), F.lit(bits)) for i in (0, 1))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + i * b, F.lit(bits)))


def part_of(key: Column, seed: int, parts: int) -> Column:
    """Which of a level's filters the key belongs to."""
    return F.pmod(F.xxhash64(F.lit(-seed - 1), key), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)


class Cascade:
    """Exact membership of the keys of a universe in its listed part."""

    def __init__(self, levels: list[tuple[int, int, list[list[int]]]], max_bits: int = 1 << 24):
        """levels: bits of a part, hashes, and the parts' words."""
        self.levels, self.max_bits = levels, max_bits

    @classmethod
    def build(cls, universe: DataFrame, lists: list[str], max_bits: int = 1 << 24, max_levels: int = 60) -> dict[str, Cascade]:
        """A cascade for each list; universe: distinct keys with a flag for each list. Two jobs a level for all lists."""
        out = {name: cls([], max_bits) for name in lists}
        counts = universe.agg(*(F.count_if(name).alias(name) for name in lists), F.count("*").alias("__all")).first() if lists else {}
        left = {name: (counts[name], counts["__all"] - counts[name]) for name in lists if counts[name]}
        level = 0
        while left:
            if level == max_levels:
                raise RuntimeError("the cascade did not end: keys whose hashes agree under every seed")
            shapes_, inside = {}, {}
            for name, (yes, no) in left.items():
                rate = min(0.5, max(1e-9, math.sqrt(0.5) * yes / max(no, 1))) if not level else 0.5
                hashes = max(1, round(-math.log2(rate)))
                needed = max(64, math.ceil(yes * hashes / math.log(2)))
                parts = math.ceil(needed / max_bits)
                shapes_[name] = (math.ceil(needed / parts), hashes, parts)
                inside[name] = (F.col(name) == (level % 2 == 0)) & out[name].passes(F.col("key"))
            at = lambda name: F.transform(places(F.col("key"), level, *shapes_[name][:2]), lambda i: F.struct(F.lit(name).alias("list"), part_of(F.col("key"), level, shapes_[name][2]).alias("part"), i.alias("at")))  # noqa: B023, E731
            marks = universe.select(F.explode(F.flatten(F.array(*(F.when(inside[name], at(name)).otherwise(F.array()) for name in left)))).alias("m")).select("m.*")
            filters = {name: [[0] * (bits // WORD + 1) for _ in range(parts)] for name, (bits, _, parts) in shapes_.items()}
            held = marks.groupBy("list", "part", F.floor(F.col("at") / WORD).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % WORD).cast("int"))).alias("bits"))
            for row in held.toLocalIterator():  # as many rows as the filters have words, a partition at a time
                filters[row["list"]][row["part"]][row["word"]] = row["bits"]
            for name, (bits, hashes, _) in shapes_.items():
                out[name].levels.append((bits, hashes, filters[name]))
            false = universe.agg(*(F.count_if((F.col(name) == (level % 2 == 1)) & out[name].passes(F.col("key"))).alias(name) for name in left)).first()
            left = {name: (false[name], yes) for name, (yes, _) in left.items() if false[name]}
            level += 1
        return out

    def level(self, key: Column, k: int) -> Column:
        bits, hashes, parts = self.levels[k]
        literal = lambda words: F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
        held = lambda words: F.forall(places(key, k, bits, hashes), lambda at: F.getbit(F.get(literal(words), F.floor(at / WORD).cast("int")), (at % WORD).cast("int")) == 1)
        found = held(parts[-1])
        for i, words in enumerate(parts[:-1]):
            found = F.when(part_of(key, k, len(parts)) == i, held(words)).otherwise(found)
        return found

    def passes(self, key: Column) -> Column:
        """Whether the key passes every level."""
        yes = F.lit(True)
        for k in range(len(self.levels)):
            yes = yes & self.level(key, k)
        return yes

    def contains(self, key: Column) -> Column:
        found = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            found = F.when(~self.level(key, k), F.lit(k % 2 == 1)).otherwise(found)
        return F.when(key.isNull(), False).otherwise(found)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, listed: Iterable[str] = LISTED, max_bits: int = 1 << 24) -> DataFrame:
    """pages with host, path, rule (the longest that fits, or null) and verdict: the rule's, or else block for a listed
    host or its subdomains, and allow for any other."""
    rules, listed = list(dict.fromkeys(rules)), list(dict.fromkeys(listed))
    groups = {"allow": [k for a, k in rules if a == "allow"], "block": [k for a, k in rules if a == "block"], "listed": listed}
    host, path = url_parts(F.col("url"))
    judged = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    shapes = sorted({shape(k) for keys in groups.values() for k in keys})
    keys = {s: F.col(f"__key_{s[0]}_{s[1]}") for s in shapes}
    judged = judged.withColumns({f"__key_{s[0]}_{s[1]}": candidate(F.col("host"), F.col("path"), s) for s in shapes})
    fits = {g: {} for g in groups}
    if shapes:
        seen = judged.select(F.explode(F.array(*keys.values())).alias("key")).filter("key is not null").select("key", *(F.lit(False).alias(g) for g in groups))
        own = json.dumps([{"key": k} | {g: k in of for g, of in groups.items()} for k in dict.fromkeys(k for of in groups.values() for k in of)])
        given = pages.sparkSession.range(1).select(F.inline(F.from_json(F.lit(own), "array<struct<key:string," + ",".join(f"{g}:boolean" for g in groups) + ">>")))
        universe = staged(seen.unionByName(given).groupBy("key").agg(*(F.max(g).alias(g) for g in groups)), "urlkeys")
        cascades = Cascade.build(universe, [g for g, of in groups.items() if of], max_bits)
        for g, cascade in cascades.items():
            for s in sorted({shape(k) for k in groups[g]}):
                flag = f"__{g}_{s[0]}_{s[1]}"
                judged = judged.withColumn(flag, cascade.contains(keys[s]))
                fits[g][s] = F.coalesce(F.col(flag), F.lit(False))
    false, null = F.lit(False), F.lit(None).cast("string")
    best = F.array(*(F.when(fits["allow"].get(s, false) | fits["block"].get(s, false), F.struct((F.length(keys[s])).alias("n"), F.lit(-s[1]).alias("m"), fits["allow"].get(s, false).alias("allow"), keys[s].alias("rule"))) for s in sorted({*fits["allow"], *fits["block"]})))
    judged = judged.withColumn("__rule", F.array_max(best) if rules else F.lit(None).cast("struct<allow:boolean,rule:string>"))
    on_list = false
    for yes in fits["listed"].values():
        on_list = on_list | yes
    rule = F.col("__rule")
    verdict = F.when(rule.isNotNull(), F.when(rule["allow"], "allow").otherwise("block")).when(on_list, "block").otherwise("allow")
    judged = judged.withColumns({"rule": F.coalesce(rule["rule"], null), "verdict": verdict})
    return judged.drop("__rule", *(c for c in judged.columns if c.startswith(("__key_", "__allow_", "__block_", "__listed_"))))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), CONTRACT).select("page_id", "host", "path", "rule", "verdict")


def _fits(key: str) -> str:
    host, slash, path = key.partition("/")
    under = f"(host = '{host}' OR ends_with(host, '.{host}'))"
    return f"({under} AND starts_with(path, '{slash + path}'))" if slash else under


OP1_SQL = f"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r AS (
  SELECT *, CASE {' '.join(f"WHEN {_fits(k)} THEN '{k}'" for _, k in sorted(RULES, key=lambda x: -len(x[1])))} END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE
  {' '.join(f"WHEN rule = '{k}' THEN '{a}'" for a, k in RULES)}
  WHEN {' OR '.join(map(_fits, LISTED))} THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
