"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its element paths (with class and id) and its text blocks under their paths, menus and notices among
them. Over the pages of a host, a token's occurrence vector says how often each page has it; tokens with equal vectors
form an equivalence class. Vectors are never gathered: each is summed up as the exclusive-or of hashes of (page, count),
with its number of pages and its total, so that equal vectors are found by one aggregation however many pages a host has.
Classes on at least half of a host's pages are valid if every path in them hangs below a path of the same or another valid
class; the valid classes, nested by their paths, are the host's template, whose places with text are slots.

What varies from page to page decides. A text is repeated if at least three of the host's pages, and one in twenty, have
it at its place. A slot almost all of whose text is repeated is part of the template, as is a text that nine pages in ten
have; neither is main text. From the root, the main slot is reached by going down to the child that holds almost all
varying text, as long as nothing that varies stands beside it in a block of its own; an article or main element is not
gone into. Word lists of element names, classes and roles (menus, headers, footers, sidebars, notices, adverts, forms,
comments) only break ties: between slots that both vary, beside each other or within the main slot. They also serve pages
that lack their host's main slot, hosts with fewer than three pages, and hosts whose pages are copies of each other, where
nothing varies.

Defined cases: a null or empty html has the text ""; pages without a host are one group; repeated rows count as pages of
their own; of slots with equally much varying text the shorter path is taken, then the first by name; unclosed and stray
tags are tolerated; paths are told apart down to DEPTH elements; a very long page is read whole; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .url_filter import url_parts

DEPTH, FLUSH = 40, 300_000
REPEATED, CONSTANT, MOSTLY = 0.05, 0.9, 0.9
#: Element names of HTML by what they mean here.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript svg math template".split())
DROPPED = set("nav footer aside form menu dialog head select button fieldset search".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LABELS = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|promo|promotion|sponsor|sponsored|sidebar|side-bar|rail|widget|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|"
    r"pager|pagination|toolbar|footer|foot|header|masthead|cookie|cookies|consent|gdpr|notice|notices|alert|popup|pop-up|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|"
    r"social|related|recommended|recommendations|comment|comments|commentlist|disqus|replies|reply|respond|discussion|skip|skip-link|sr-only|hidden|copyright|legal)(?:$|[-_\s\d])",
    re.I,
)
CONTAINER = re.compile(r"(?:div|section|body|html|article|main|td|tr|table|tbody|center|nav|aside|header|footer|form|details|dialog|fieldset|hgroup|search|menu)(?:\.|$)")
NAMED = re.compile(r"(?:article|main)(?:\.|$)")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^<>"']*(?:(?:"[^"]*"|'[^']*')[^<>"']*)*)>|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], bool, str]]:
    """(path, listed, text) of each text block in page order; listed: by the word lists no main text."""
    path: list[tuple[str, str, bool]] = []  # element, label, listed
    parts: list[str] = []
    at = 0

    def close() -> Iterator[tuple]:
        nonlocal parts
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                yield tuple(x[1] for x in path[:DEPTH]), bool(path) and path[-1][2], text
        parts = []

    def add(text: str) -> None:
        parts.append(entities.unescape(text) if "&" in text else text)

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            yield from close()
            return
        if m.start() > at:
            add(page[at : m.start()])
        at, ending, name = m.end(), m[1], (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
        if not ending and name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name not in BLOCKS:
            continue
        yield from close()
        if name in VOID:
            continue
        if ending:
            for i in reversed(range(len(path))):
                if path[i][0] == name:
                    del path[i:]
                    break
            continue
        if path and path[-1][0] == "p":
            path.pop()
        if path and path[-1][0] in CLOSES.get(name, ()):
            path.pop()
        label, given = name, m[3]
        inside = bool(path) and path[-1][2]
        dropped = inside or name in DROPPED or name == "header" and not any(x[0] in ("article", "main") for x in path)
        if given and not given.isspace():
            own = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(given)}
            kind = f"{own.get('class', '')} {own.get('id', '')}".strip()
            if kind:
                label += "." + re.sub(r"\d\d+", "0", kind)[:80].replace("/", "|")  # numbers of pages and posts
            if name not in ("html", "body", "article", "main") or "comment" in kind.lower():
                dropped = dropped or bool(kind) and bool(LABELS.search(kind))
            style = own.get("style", "").replace(" ", "").lower()
            dropped = dropped or own.get("role", "").lower() in ROLES or "display:none" in style or own.get("aria-hidden") == "true" or bool(re.search(r"(?:^|\s)hidden(?:\s|$)", given))
        path.append((name, label, dropped))


def text_key(path: tuple[str, ...], text: str) -> str:
    return xxhash.xxh64_hexdigest("/".join(path) + "\n" + text)


def page_tokens(page: str | None) -> dict[tuple, list]:
    """(path, text's key or None for the path itself) -> [count, characters under it, those of them listed]."""
    out: dict[tuple, list] = {("", None): [1, 0, 0]}
    for path, listed, text in blocks(page or ""):
        for i in range(len(path) + 1):
            got = out.setdefault(("/".join(path[:i]), None), [0, 0, 0])
            got[0] += i == len(path) or got[0] == 0
            got[1] += len(text)
            got[2] += len(text) * listed
        got = out.setdefault(("/".join(path), text_key(path, text)), [0, 0, 0])
        got[0] += 1
        got[1] += len(text)
    return out


def _vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, path, text, vector, pages, total, chars, listed), summed up over the pages of this task."""
    found: dict[tuple, list] = {}
    page = TaskContext.get().partitionId() << 33

    def flush() -> pd.DataFrame:
        rows = [(*k, *x) for k, x in found.items()]
        found.clear()
        return pd.DataFrame(rows, columns=["host", "path", "text", "vector", "pages", "total", "chars", "listed"])

    for part in parts:
        for host, source in zip(part["host"], part["html"]):
            page += 1
            for (path, text), (count, chars, listed) in page_tokens(source).items():
                got = found.setdefault((host, path, text), [0, 0, 0, 0, 0])
                got[0] ^= xxhash.xxh64_intdigest(f"{page} {count}") - (1 << 63)
                got[1] += 1
                got[2] += count
                got[3] += chars
                got[4] += listed
            if len(found) > FLUSH:
                yield flush()
    if found:
        yield flush()


def deduce(tokens: list[tuple], pages: int) -> tuple[str | None, list[str], list[str]]:
    """(main slot, repeated slots, constant texts) of one host's frequent tokens (path, text, vector, pages, total, chars,
    listed, repeated); repeated: characters of repeated texts right at the path."""
    by_class: dict[tuple, list] = {}
    for x in tokens:
        by_class.setdefault((x[2], x[3], x[4]), []).append(x)
    while True:  # a class goes if one of its paths hangs below none that is left
        held = {x[0] for own in by_class.values() for x in own if x[1] is None}
        loose = [v for v, own in by_class.items() if any(x[0] and x[0].rpartition("/")[0] not in held for x in own)]
        if not loose:
            break
        for v in loose:
            del by_class[v]
    template = {x[0]: (x[5], x[6], x[7]) for own in by_class.values() for x in own if x[1] is None}
    constant = [x[1] for v, own in by_class.items() for x in own if x[1] is not None and v[1] >= CONSTANT * pages]
    if "" not in template:
        return None, [], []
    repeated = dict.fromkeys(template, 0)
    for path, (_, _, own) in template.items():
        while True:
            repeated[path] += own
            if not path:
                break
            path = path.rpartition("/")[0]
    varying = {p: x[0] - repeated[p] for p, x in template.items()}
    if pages < 3 or varying.get("", 0) <= (1 - MOSTLY) * template[""][0]:
        return None, [], []
    children: dict[str, list[str]] = {}
    for p in template:
        if p:
            children.setdefault(p.rpartition("/")[0], []).append(p)
    still = {p for p, (chars, _, _) in template.items() if p and repeated[p] >= MOSTLY * chars}
    main = ""
    while True:
        kind = main.rpartition("/")[2]
        below = [p for p in children.get(main, []) if p not in still]
        slots = [p for p in below if CONTAINER.match(p.rpartition("/")[2])]
        if NAMED.match(kind) or not slots or len(slots) < len(below) or varying[main] - sum(varying[p] for p in below) > (1 - MOSTLY) * varying[main]:
            break
        best = min(slots, key=lambda p: (2 * template[p][1] > template[p][0], -varying[p], len(p), p))
        tied = sum(varying[p] for p in slots if p != best and 2 * template[p][1] <= template[p][0])
        if varying[best] < MOSTLY * (varying[best] + tied):
            named = [p for p in slots if NAMED.match(p.rpartition("/")[2]) and varying[p] >= 0.5 * (varying[best] + tied)]
            if not named:
                break
            best = named[0]
        main = best
    return main, sorted(still), constant


def _template(pdf: pd.DataFrame) -> pd.DataFrame:
    """(host, main, still, texts) of one host."""
    rows = [(x.path, None if pd.isna(x.text) else x.text, x.vector, x.pages, x.total, x.chars, x.listed, x.repeated) for x in pdf.itertuples()]
    main, still, texts = deduce(rows, int(pdf["all"].iloc[0]))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "main": [main], "still": [still], "texts": [texts]})


def main_text(page: str | None, main: str | None, still: set[str], texts: set[str]) -> str:
    """The blocks of the main slot (a path; null: not known) without what the template repeats."""
    found = list(blocks(page or ""))
    slot = []
    if main is not None:
        top = tuple(main.split("/")) if main else ()
        inside = [x for x in found if x[0][: len(top)] == top]
        slot = [x for x in inside if text_key(x[0], x[2]) not in texts and not any("/".join(x[0][:i]) in still for i in range(len(top) + 1, len(x[0]) + 1))]
        if any(not x[1] for x in slot):
            slot = [x for x in slot if not x[1]]
        elif any(not x[1] for x in inside):  # a page of nothing but repeated texts
            slot = [x for x in inside if not x[1]]
    if not slot:
        slot = found = [x for x in found if not x[1]]
        for i in sorted({i for p, *_ in found for i, e in enumerate(p) if NAMED.match(e)}):
            own = [x for x in found if len(x[0]) > i and NAMED.match(x[0][i])]
            if 2 * sum(len(x[2]) for x in own) >= sum(len(x[2]) for x in found):
                slot = own
                break
    return "\n\n".join(x[2] for x in slot)


def _extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for a in range(0, len(part), 1000):
            some = part.iloc[a : a + 1000]
            known = [() if x is None else x for c in ("still", "texts") for x in some[c]]
            text = [main_text(h, m, set(s), set(t)) for h, m, s, t in zip(some["html"], some["main"], known, known[len(some) :])]
            yield pd.DataFrame({"page_id": some["page_id"], "url": some["url"], "text": text, "n_chars": [len(t) for t in text]})


def extract_text(pages: DataFrame, support: float = 0.5) -> DataFrame:
    """(page_id, url, text, n_chars) of each row (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html", url_parts(F.col("url"))[0].alias("host"))
    vectors = rows.select("host", "html").mapInPandas(_vectors, "host string, path string, text string, vector long, pages long, total long, chars long, listed long")
    found = vectors.groupBy("host", "path", "text").agg(F.bit_xor("vector").alias("vector"), *(F.sum(c).alias(c) for c in ("pages", "total", "chars", "listed")))
    found = staged(found.filter("pages > 1 or path = ''"), "tokens")
    hosts = found.filter("path = '' and text is null").select("host", F.col("pages").alias("all"))
    known = found.join(hosts, "host")
    repeated = known.filter((F.col("pages") >= F.greatest(F.lit(3), F.col("all") * REPEATED)) & F.col("text").isNotNull()).groupBy("host", "path").agg(F.sum("chars").alias("repeated"))
    often = known.filter(F.col("pages") >= F.when(F.col("text").isNull(), support).otherwise(CONSTANT) * F.col("all"))
    often = often.join(repeated, ["host", "path"], "left").withColumn("repeated", F.when(F.col("text").isNull(), F.coalesce("repeated", F.lit(0))).otherwise(0).cast("long"))
    # a host has at most 1 / support times a page's mean number of tokens here
    template = staged(often.groupBy("host").applyInPandas(_template, "host string, main string, still array<string>, texts array<string>"), "templates")
    return rows.join(template, "host", "left").select("page_id", "url", "html", "main", "still", "texts").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")


def op3_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
