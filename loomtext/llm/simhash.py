"""SimHash near-duplicates by a binary trie self-join.

A fingerprint has one or several words of 64 bits, each bit by majority over the hashes of a text's shingles. The distinct
fingerprints form a binary trie over their bits. The join goes down pairs of nodes together, from (root, root): a pair of
equal children keeps the differing bits so far, a pair of unequal ones has one more, and a pair beyond the budget is
dropped.

Several tries share the work, each over its own block of bits with a smaller budget: fingerprints that differ in fewer
than (block budget + 1) * tries of these bits differ in at most the block budget within some block, where that trie meets
them; the pair then counts if all words together differ in at most the budget. With 64 bits, a budget of 2 and three
tries, a block's bits may not differ at all, so that each fingerprint goes to one node of each trie and no link is lost.

The upper trie is walked on the driver over nodes alone, whose counts come from one aggregation: a node is split until it
holds at most `most` fingerprints, what a task's memory bears with ease (more, where the driver would have too many
nodes); one whose bits end before is dealt
in chunks by hash. Each surviving pair of leaf nodes is a block for one task, which walks the lower trie of that pair in
arrays. A task returns a spanning forest of the links it finds, not the links, so that a dense group of m fingerprints
gives fewer than m rows.

Components are joined up by one task in arrays as long as all links fit into them with ease, which are far fewer than the
texts, and beyond by alternating large-star and small-star steps over tables in the shared folder, each of which has a
shuffle's tasks many times over. Copies of one text share a fingerprint and enter once. Hot keys are salted where rows
meet their class.

Bits alone cannot tell a Jaccard similarity of 0.8 from somewhat less. `similar` therefore takes the tries' links, with a
budget beyond the mean at 0.8 by three and a half standard deviations, as candidates: what they connect are clusters, and
within a cluster texts are linked by the exact similarity of their shingle sets. Texts are compared by classes of size
only, since at 0.8 sets differ by a quarter in size at most.

Defined cases: a null text is an empty one; empty texts have fingerprint zero, which links like any other; texts without
words are near duplicates of each other alone; a null doc_id takes part but names no component unless its whole component
is null; ties go to the smaller doc_id; repeated rows are all returned; a very long text is read whole, in pieces of
bounded size; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

BITS, CHUNK, SALTS = 64, 1 << 16, 8


def words_of(text: str | None) -> list[bytes]:
    """Only A-Z are lower-cased, and only ASCII white space separates."""
    return (text or "").encode(errors="surrogatepass").lower().split()


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """Of the shingles, repeats included; a text of fewer words is one shingle, one without words has none."""
    found = words_of(text)
    if not found:
        return np.zeros(0, "<u8")
    n, digest, join, out = max(1, len(found) - shingle + 1), xxhash.xxh64_intdigest, b" ".join, []
    for a in range(0, n, CHUNK):
        own = found[a : a + CHUNK + shingle - 1]
        each = zip(*(own[i:] for i in range(shingle))) if len(found) >= shingle else [own]
        out.append(np.fromiter((digest(join(x), 42) for x in each), "<u8"))
    return np.concatenate(out)


def majority(sets: list[np.ndarray], words: int) -> np.ndarray:
    """Fingerprints (texts, words) of the texts' hashes. The first word is by the hashes themselves, the others by
    scramblings of them. Bits are summed in byte lanes, at most 255 rows at a time."""
    out = np.zeros((len(sets), words), np.uint64)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= 1 << 18):
            size += len(sets[last])
            last += 1
        own = [i for i in range(first, last) if len(sets[i])]
        first = last
        if not own:
            continue
        counts = np.array([len(sets[i]) for i in own])
        h, parts = np.concatenate([sets[i] for i in own]), -(-counts // 255)
        begin = np.repeat(np.cumsum(counts) - counts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        for w in range(words):
            lanes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view("<u8")
            sums = np.add.reduceat(lanes, begin, axis=0).view(np.uint8)
            ones = np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
            out[own, w] = np.packbits(ones * 2 > counts[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out


def fingerprints(texts: Column, shingle: int = 3, words: int = 1) -> Column:
    """As array<long>: the unsigned words' bits."""

    @F.pandas_udf("array<long>")
    def of(part: pd.Series) -> pd.Series:
        return pd.Series(list(majority([hashes(x, shingle) for x in part], words).view(np.int64)), dtype=object)

    return of(texts)


def walk(a: np.ndarray, b: np.ndarray, same: bool, budget: int, depth: int = BITS, small: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs into sorted a and b whose upper depth bits may differ in at most budget bits, and at any rate all that
    do. same: b is a; each pair comes once."""
    todo = [(0, len(a), 0, len(b), BITS - 1, budget, same)]
    while todo:
        p, q, r, s, bit, left, own = todo.pop()
        if p == q or r == s:
            continue
        if bit < BITS - depth or (q - p) * (s - r) <= small:
            step = max(1, (1 << 20) // (s - r))
            for x in range(p, q, step):
                near = np.bitwise_count((a[x : min(q, x + step), None] ^ b[None, r:s]) >> np.uint64(BITS - depth)) <= budget
                i, j = np.nonzero(near)
                i, j = i + x, j + r
                if own:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield i, j
            continue
        mask = np.uint64(1 << bit)
        m = p + int(np.searchsorted(a[p:q] & mask, mask))
        n = m if own else r + int(np.searchsorted(b[r:s] & mask, mask))
        todo += [(p, m, r, n, bit - 1, left, own), (m, q, n, s, bit - 1, left, own)]
        if left:
            todo.append((p, m, n, s, bit - 1, left - 1, False))
            if not own:
                todo.append((m, q, r, n, bit - 1, left - 1, False))


class Forest:
    """Roots (smallest index) of points that are joined pair by pair."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def apart(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        differ = self.root[x] != self.root[y]
        return x[differ], y[differ]

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        root = self.root
        while True:
            u, v = root[x], root[y]
            if (u == v).all():
                break
            np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
            while (root[root] != root).any():
                root = root[root]
        self.root = root


def _block(walked: int, depth: int, budget: int, few: int, more: int, more_budget: int) -> Callable:
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        """Spanning edges of one block: the rows of its one or two nodes. Rows of two size classes meet, or of the lower."""
        key, side, upper = pdf["key"].to_numpy().view(np.uint64), pdf["side"].to_numpy(), pdf["upper"].to_numpy()
        order = np.lexsort((key, upper, side))
        key, side, upper, ids = key[order], side[order], upper[order], pdf["id"].to_numpy()[order]
        wide = np.frombuffer(b"".join(pdf["fp"].iloc[order]), "<u8").reshape(len(ids), -1)
        small = few and int(pdf["class"].iloc[0]) < few
        bits, limit = (more, more_budget) if small else (walked, budget)
        cuts = np.searchsorted(side * 2 + upper, np.arange(5))
        part = [slice(cuts[i], cuts[i + 1]) for i in range(4)]  # side and class: 0 lower, 0 upper, 1 lower, 1 upper
        met = [(0, 0, True), (0, 1, False)] if cuts[2] == len(ids) else [(0, 2, False), (0, 3, False), (1, 2, False)]
        forest = Forest(len(ids))
        for i, j, own in met:
            for x, y in walk(key[part[i]], key[part[j]], own, bits, depth):
                x, y = forest.apart(x + part[i].start, y + part[j].start)
                for a in range(0, len(x), 1 << 18):
                    u, v = x[a : a + (1 << 18)], y[a : a + (1 << 18)]
                    near = np.bitwise_count(wide[u] ^ wide[v]).sum(1, dtype=np.int64) <= limit
                    forest.join(u[near], v[near])
        moved = np.nonzero(forest.root != np.arange(len(ids)))[0]
        return pd.DataFrame({"u": ids[forest.root[moved]], "v": ids[moved]})

    return links


def nodes(counts: dict[int, int], depth: int, most: int) -> list[tuple[int, int, int]]:
    """Leaf nodes (bits, length, fingerprints) of the upper trie. counts: of the prefixes of depth bits."""
    out, todo = [], [(0, 0, sorted(counts))]
    while todo:
        value, length, below = todo.pop()
        size = sum(counts[x] for x in below)
        if length == depth or size <= most:
            out.append((value, length, size))
            continue
        for bit in (0, 1):
            if part := [x for x in below if x >> (depth - length - 1) & 1 == bit]:
                todo.append((value << 1 | bit, length + 1, part))
    return out


def node_pairs(leaves: list[tuple[int, int]], budget: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Pairs of leaf nodes that a walk from (root, root) reaches within the budget; a node with itself first."""
    held, own = set(leaves), set()
    for value, length in leaves:
        own |= {(value >> (length - k), k) for k in range(length + 1)}
    out, todo = [], [((0, 0), (0, 0), budget)]
    below = lambda n: [n] if n in held else [c for c in ((n[0] << 1, n[1] + 1), (n[0] << 1 | 1, n[1] + 1)) if c in own]
    while todo:
        a, b, left = todo.pop()
        if a in held and b in held:
            out.append((a, b))
        elif a == b:
            c = below(a)
            todo += [(x, x, left) for x in c]
            if len(c) == 2 and left:
                todo.append((c[0], c[1], left - 1))
        else:
            for x in below(a):
                for y in below(b):
                    k = min(x[1], y[1])
                    n = max(min(a[1], b[1]), 0)
                    differ = ((x[0] >> (x[1] - k)) ^ (y[0] >> (y[1] - k))) & ((1 << (k - n)) - 1)
                    if differ.bit_count() <= left:
                        todo.append((x, y, left - differ.bit_count()))
    return out


def keys(wide: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits of fingerprints (rows, words) at the places, the first on top."""
    bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(wide), -1), axis=1, bitorder="little")
    top = np.zeros((len(wide), BITS), np.uint8)
    top[:, : len(places)] = bits[:, places]
    return np.packbits(top, axis=1).view(">u8")[:, 0].astype(np.uint64)


class Plan:
    """Where each fingerprint of a trie and size class goes."""

    def __init__(self):
        self.tables: dict[tuple[int, int], tuple] = {}
        self.blocks = 0

    def add(self, trie: int, unit: int, counts: dict[int, int], depth: int, most: int, walked: int) -> None:
        leaves = nodes(counts, depth, most)
        chunks = [max(1, -(-size // most)) for *_, size in leaves]
        number = {(v, n): i for i, (v, n, _) in enumerate(leaves)}
        starts = np.concatenate([[0], np.cumsum(chunks)])
        to: list[list[tuple[int, int]]] = [[] for _ in range(starts[-1])]
        for a, b in node_pairs(list(number), walked):
            i, j = number[a], number[b]
            for p in range(starts[i], starts[i + 1]):
                for q in range(p if i == j else starts[j], starts[j + 1]):
                    to[p].append((self.blocks, 0))
                    if p != q:
                        to[q].append((self.blocks, 1))
                    self.blocks += 1
        of_top = np.zeros(1 << depth, np.int64)
        for (value, n), i in number.items():
            of_top[value << (depth - n) : (value + 1) << (depth - n)] = i
        sizes = np.array([len(x) for x in to])
        self.tables[trie, unit] = depth, of_top, starts[:-1], np.array(chunks), sizes, np.cumsum(sizes) - sizes, np.array([x for own in to for x in own], np.int64).reshape(-1, 2)

    def spread(self, trie: int, unit: int, key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, block, side), each row as often as it goes somewhere."""
        depth, of_top, starts, chunks, sizes, first, to = self.tables[trie, unit]
        leaf = of_top[(key >> np.uint64(BITS - depth)).astype(np.int64)] if depth else np.zeros(len(key), np.int64)
        node = starts[leaf] + (ids.view(np.uint64) % chunks[leaf].astype(np.uint64)).astype(np.int64)
        times = sizes[node]
        at = np.repeat(first[node] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        return np.repeat(np.arange(len(key)), times), to[at, 0], to[at, 1]


def links(distinct: DataFrame, budget: int = 2, tries: int = 3, bits: int | None = None, walked: int = 0, most: int = 1 << 18, depth: int = 18, few: int = 0, more: int = 0, more_budget: int = 0) -> DataFrame:
    """Spanning edges (u, v) by id of distinct (id, fp: binary words, class) within budget differing bits.

    Each trie is over a block of `bits` bits (unset: its share of the first word, then all other bits of it, whose walk
    goes on within the whole budget) with `walked` differing bits at most. Fingerprints meet in one class or the next; the
    classes below `few` have the budgets `more` and `more_budget`."""
    none = distinct.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)
    classes = {r["class"]: r["count"] for r in distinct.groupBy("class").count().collect()}  # by size: some dozens
    if not classes:
        return none
    total = sum(classes.values())
    most = max(most, total >> (8 if walked else 16))  # nodes of one trie and class; with a budget each meets many
    if bits:
        places = [np.arange(t * bits, (t + 1) * bits) for t in range(tries)]
        split = bits
    else:
        places = [np.concatenate([np.arange(t, BITS, tries), np.setdiff1d(np.arange(BITS), np.arange(t, BITS, tries))]) for t in range(tries)]
        split = BITS // tries
    units = {c: classes[c] + classes.get(c + 1, 0) for c in classes}
    deep = {u: min(depth, split, max(0, math.ceil(math.log2(n / most)) + 2)) if n > most else 0 for u, n in units.items()}
    large = {u: d for u, d in deep.items() if d}
    if not bits and not large:  # one node: a single trie meets all
        places, tries = places[:1], 1
    counts: dict[tuple[int, int], dict[int, int]] = {(t, u): {} for t in range(tries) for u in units}
    held = distinct.sparkSession.sparkContext.broadcast((places, units, large))

    def read(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(part["fp"]), "<u8").reshape(len(part), -1), part["class"].to_numpy(), part["id"].to_numpy()

    def tops(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, _, large = held.value
        found: dict[tuple[int, int, int], int] = {}
        for part in parts:
            wide, own, _ = read(part)
            for t, at in enumerate(places):
                key = keys(wide, at)
                for u, d in large.items():
                    top, n = np.unique(key[(own == u) | (own == u + 1)] >> np.uint64(BITS - d), return_counts=True)
                    for x, y in zip(top.tolist(), n.tolist()):
                        found[t, u, x] = found.get((t, u, x), 0) + y
        yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["trie", "unit", "top", "n"])

    if large:  # at most 2 ** depth rows for each trie and class, and four for each node
        for r in distinct.mapInPandas(tops, "trie int, unit int, top long, n long").groupBy("trie", "unit", "top").agg(F.sum("n").alias("n")).collect():
            counts[r["trie"], r["unit"]][r["top"]] = r["n"]
    plan = Plan()
    for t in range(tries):
        for u, n in units.items():
            plan.add(t, u, counts[t, u] if deep[u] else {0: n}, deep[u], most, more if u < few else walked)
    where = distinct.sparkSession.sparkContext.broadcast(plan)

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, units, _ = held.value
        for part in parts:
            for a in range(0, len(part), 4096):
                some = part.iloc[a : a + 4096]
                wide, own, ids = read(some)
                out: list[tuple] = []
                for t, at in enumerate(places):
                    key = keys(wide, at)
                    for u in map(int, np.unique(np.concatenate([own, own - 1]))):
                        if u in units and len(rows := np.nonzero((own == u) | (own == u + 1))[0]):
                            i, block, side = where.value.spread(t, u, key[rows], ids[rows])
                            i = rows[i]
                            out.append((i, key[i].view(np.int64), block, side, own[i] - u, np.full(len(i), u)))
                i, key, block, side, upper, unit = map(np.concatenate, zip(*out))
                yield some.iloc[i][["id", "fp"]].assign(key=key, block=block, side=side.astype(np.int32), upper=upper.astype(np.int32), **{"class": unit.astype(np.int32)})

    spread_out = distinct.select("id", "fp", "class").mapInPandas(spread, "id long, fp binary, key long, block long, side int, upper int, class int")
    ends = (walked, bits) if bits else (budget, BITS)
    return spread_out.groupBy("block").applyInPandas(_block(*ends, budget, few, more, more_budget), "u long, v long")


def salted(rows: DataFrame, few: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined to few (one row a key) by key, a hot key's rows dealt to several tasks by their column `by`."""
    dealt = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(dealt, [key, "__salt"], how).drop("__salt")


def _joined_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(v, root) of all edges (u, v) of all parts."""
    held = [part[["u", "v"]].to_numpy(np.int64) for part in parts if len(part)]
    if held:
        ends, at = np.unique(np.concatenate(held), return_inverse=True)
        at = at.reshape(-1, 2)
        forest = Forest(len(ends))
        forest.join(at[:, 0], at[:, 1])
        moved = np.nonzero(forest.root != np.arange(len(ends)))[0]
        for a in range(0, len(moved), CHUNK):
            some = moved[a : a + CHUNK]
            yield pd.DataFrame({"v": ends[some], "root": ends[forest.root[some]]})


def components(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(v, root) of all ends of edges (u, v) but the roots: the smallest end reachable. At most `most` edges are joined up by
    one task, more by alternating large and small stars."""
    edges = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v"), "links")
    if edges.count() <= most:
        return staged(edges.coalesce(1).mapInPandas(_joined_up, "v long, root long"), "roots")
    edges = staged(edges.distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = salted(both.filter("v > u"), low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted(large, low, "u", "v").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.*")
        edges = staged(small.filter("u != v").distinct(), "links")
        seen = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen == state:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        state = seen


def classes(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root) of the ids of distinct (id, copies, ...) that have company; roots: (v, root)."""
    groups = distinct.join(roots.select(F.col("v").alias("id"), "root"), "id", "left").filter("root is not null or copies > 1").withColumn("root", F.coalesce("root", "id"))
    alone = distinct.filter("copies = 1").join(roots.select(F.col("root").alias("id")).distinct(), "id", "left_semi")
    return groups.unionByName(alone.withColumn("root", F.col("id")))


def named(rows: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (id, doc_id, ...) with component_id. distinct: (id, least, copies); roots: (v, root)."""
    groups = classes(distinct, roots)
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    by_id = staged(groups.select("id", "root").join(least, "root").select("id", "component_id", F.lit(True).alias("__in")), "classes")
    return salted(rows, by_id, "id", "doc_id", "left").withColumn("component_id", F.when(F.col("__in"), F.col("component_id")).otherwise(F.col("doc_id"))).drop("__in")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2, most: int = 32768) -> DataFrame:
    """(doc_id, fp, component_id) of each row (doc_id, text), by fingerprints of 64 bits."""
    rows = docs.select("doc_id", F.get(fingerprints(F.col("text"), shingle), F.lit(0)).alias("id"))
    rows = staged(rows, "fingerprints")
    distinct = staged(rows.groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    edges = links(distinct.select("id", _bytes(F.col("id")).alias("fp"), F.lit(0).alias("class")), budget, budget + 1, most=most)
    return named(rows, distinct, components(edges)).select("doc_id", F.col("id").alias("fp"), "component_id")


def _bytes(c: Column) -> Column:
    """A long's eight bytes, the lowest first."""
    text = F.lpad(F.hex(c), 16, "0")
    return F.unhex(F.concat(*(F.substring(text, 15 - 2 * i, 2) for i in range(8))))


def sketches(texts: Column, shingle: int, words: int) -> Column:
    """struct(n, fp): the number of distinct shingles and their fingerprint."""

    @F.pandas_udf("n int, fp binary")
    def of(part: pd.Series) -> pd.DataFrame:
        sets = [np.unique(hashes(x, shingle)) for x in part]
        return pd.DataFrame({"n": [len(x) for x in sets], "fp": [x.tobytes() for x in majority(sets, words).astype("<u8")]})

    return of(texts)


def joined(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Root (an index) of each set: sets linked at this Jaccard similarity or more, every link counted.

    From one set after the other, all sets not reached yet are compared with it in one sweep; sets whose shingles most
    others have come first, so that a dense group is reached in few sweeps."""
    root = np.arange(len(sets))
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if sizes.sum() else np.zeros(0, np.int64)
    begin = np.cumsum(sizes) - sizes
    often = np.bincount(codes)
    weight = np.array([often[codes[b : b + n]].mean() if n else 0.0 for b, n in zip(begin, sizes)])
    order = np.argsort(-weight, kind="stable")
    mark = np.zeros(len(often) + 1, np.int32)
    open_ = order[sizes[order] > 0]
    while len(open_):
        start, open_ = open_[0], open_[1:]
        waiting = [start]
        while waiting and len(open_):
            x = waiting.pop(0)
            near = (sizes[open_] >= similarity * sizes[x] - 1e-9) & (sizes[x] >= similarity * sizes[open_] - 1e-9)
            some = open_[near]
            if not len(some):
                continue
            mark[codes[begin[x] : begin[x] + sizes[x]]] = 1
            at = np.repeat(begin[some] - (np.cumsum(sizes[some]) - sizes[some]), sizes[some]) + np.arange(sizes[some].sum())
            shared = np.add.reduceat(mark[codes[at]], np.cumsum(sizes[some]) - sizes[some])
            mark[codes[begin[x] : begin[x] + sizes[x]]] = 0
            hit = some[shared / (sizes[x] + sizes[some] - shared) >= similarity]
            root[hit] = start
            waiting += sorted(hit.tolist(), key=lambda i: -weight[i])
            open_ = open_[~np.isin(open_, hit)]
    return root


def _exact(shingle: int, similarity: float) -> Callable:
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby("cluster", sort=False):
            ids = own["id"].to_numpy()
            root = joined([np.unique(hashes(x, shingle)) for x in own["text"]], similarity)
            moved = np.nonzero(root != np.arange(len(ids)))[0]
            out.append(pd.DataFrame({"u": ids[root[moved]], "v": ids[moved]}))
        return pd.concat(out)

    return links


def tasks_of(members: DataFrame, most: int) -> DataFrame:
    """members (id, cluster, n) with `task`, as often as they go somewhere: clusters of at most `most` shingles bundled, a
    larger one cut by size classes and chunks, of which all pairs that can hold partners meet."""
    sizes = staged(members.groupBy("cluster", "class").agg(F.sum("n").alias("e")), "sizes")
    whole = sizes.groupBy("cluster").agg(F.sum("e").alias("e"), F.map_from_entries(F.collect_list(F.struct("class", F.ceil(2 * F.col("e") / most).cast("int").alias("c")))).alias("cuts"))
    total = sizes.agg(F.coalesce(F.sum("e"), F.lit(0))).first()[0]
    bundles = max(1, min(4 * members.sparkSession.sparkContext.defaultParallelism, total // 10_000), math.ceil(2 * total / most))
    small = whole.filter(F.col("e") <= most).select("cluster")
    one = members.join(small, "cluster").withColumn("task", F.pmod(F.xxhash64("cluster"), F.lit(bundles)).cast("string"))
    large = members.join(whole.filter(F.col("e") > most).select("cluster", "cuts"), "cluster")
    k, cut = F.col("class"), lambda c: F.coalesce(F.element_at(F.col("cuts"), c), F.lit(0))
    i = F.pmod(F.xxhash64("id"), cut(k)).cast("int")
    name = lambda a, p, b, q: F.concat_ws(":", F.col("cluster"), a, p, b, q)
    every = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<string>"))
    own = every(cut(k), lambda j: name(k, F.least(i, j), k, F.greatest(i, j)))
    after, before = every(cut(k + 1), lambda j: name(k, i, k + 1, j)), every(cut(k - 1), lambda j: name(k - 1, j, k, i))
    many = large.withColumn("task", F.explode(F.concat(own, after, before))).drop("cuts")
    return one.unionByName(many)


def with_ids(docs: DataFrame) -> Column:
    """A text's id: a 64-bit hash; all texts without words are one."""
    return F.xxhash64(F.when(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.col("text")).otherwise(""))


def linked(docs: DataFrame, shingle: int, similarity: float, words: int, tries: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (doc_id, id), distinct (id, least, copies, times: rows with the least doc_id) and the links' (v, root)."""
    texts = docs.select("doc_id", "text", with_ids(docs).alias("id"))
    rows = texts.withColumn("p", sketches(F.col("text"), shingle, words))
    size = F.when(F.col("p.n") > 0, F.floor(F.ln("p.n") / -math.log(similarity))).otherwise(-9).cast("int")
    rows = staged(rows.select("doc_id", "id", "p.n", "p.fp", size.alias("class")), "sketches")
    of_id = rows.groupBy("id", "doc_id").agg(F.count("*").alias("c"), *(F.first(c).alias(c) for c in ("n", "fp", "class"))).groupBy("id").agg(
        F.min("doc_id").alias("least"), F.sum("c").alias("copies"), F.coalesce(F.min_by("c", "doc_id"), F.sum("c")).alias("times"), *(F.first(c).alias(c) for c in ("n", "fp", "class")))
    distinct = staged(of_id, "distinct")
    beyond = lambda p: math.ceil(BITS * words * p + 3.5 * math.sqrt(BITS * words * p * (1 - p)))
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    small = int(math.log(64) / -math.log(similarity))
    found = components(links(distinct.select("id", "fp", "class"), beyond(share), tries, 24, 3, few=small, more=4, more_budget=beyond(share * 1.25)))
    clusters = found.select(F.col("v").alias("id"), F.col("root").alias("cluster"))
    clusters = clusters.unionByName(found.select(F.col("root").alias("id"), F.col("root").alias("cluster")).distinct())
    members = staged(clusters.join(distinct.select("id", "least", "n", "class"), "id"), "members")
    # of a text's copies one with the least doc_id is read
    # members grow with the texts: never broadcast, so that plans are alike at every size
    one = members.select(F.col("id").alias("__id"), F.col("least").alias("__least")).hint("merge")
    read = texts.join(one, (F.col("id") == F.col("__id")) & F.col("doc_id").eqNullSafe(F.col("__least"))).select("id", "text").dropDuplicates(["id"])
    tasks = tasks_of(members.select("id", "cluster", "n", "class"), most).join(read, "id").select("id", "cluster", "task", "text")
    return rows.select("doc_id", "id"), distinct, components(tasks.groupBy("task").applyInPandas(_exact(shingle, similarity), "u long, v long"))


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 4, tries: int = 10, most: int = 2_000_000) -> DataFrame:
    """(doc_id, component_id) of each row: texts linked whose sets of shingles have at least this Jaccard similarity.

    Candidates are the links of `tries` tries of 24 bits, in which three bits may differ (four below 64 shingles, whose
    majorities are less even), and 3.5 standard deviations beyond the mean number of differing bits at this similarity
    over all words. Each cluster of them is then settled by its texts' sets, at most `most` shingles in a task."""
    rows, distinct, roots = linked(docs, shingle, similarity, words, tries, most)
    return named(rows, distinct, roots).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 4, tries: int = 10, most: int = 2_000_000) -> DataFrame:
    """docs without near duplicates (as `similar` links them): of each group the row with the smallest doc_id stays, ties to
    the smaller hash of the text, and of equal rows one. A null doc_id comes last. Different texts with one doc_id that are
    not alike all stay."""
    rows, distinct, roots = linked(docs, shingle, similarity, words, tries, most)
    groups = staged(classes(distinct, roots).select("id", "root", "least", "times"), "classes")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "id", "times")).alias("first"))
    by_id = groups.select("id", "root").join(first, "root").select("id", "first")
    own = (F.col("first.id") == F.col("id")) & F.col("first.least").eqNullSafe(F.col("doc_id"))
    named_ = staged(salted(rows, by_id, "id", "doc_id").groupBy("id", "doc_id").agg(F.bool_or(own).alias("own"), F.max("first.times").alias("times")).filter("not own or times > 1"), "others")
    keyed = docs.withColumn("__id", with_ids(docs))
    same = lambda other: (F.col("__id") == other["id"]) & F.col("doc_id").eqNullSafe(other["__doc"])
    others = named_.withColumnRenamed("doc_id", "__doc")
    kept = keyed.join(others.hint("merge"), same(others), "left_anti").select(docs.columns)
    many = others.filter("own").select("id", "__doc")
    if many.isEmpty():
        return kept
    again = keyed.join(many, same(many), "left_semi").withColumn("__n", F.row_number().over(Window.partitionBy("__id", "doc_id").orderBy(F.lit(0)))).filter("__n = 1")
    return kept.unionByName(again.select(docs.columns))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
