"""Query analysis: a query's clean form, its concepts and terms, filters and sizes. A query is text of a person's length;
columns of queries are analysed by expressions, and a single one by the same expressions over one row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# What is cut from a query's beginning and end, words without meaning in it, and what asks for a definition.
PREFIXES = (
    r"(?:toi )?(?:muon|can) tim ", r"(?:hay )?tim (?:kiem )?(?:cho toi )?", r"(?:cho toi )?tim (?:bai kinh|doan kinh|kinh|doan) ",
    r"(?:bai kinh|doan kinh|kinh|doan) ", r"(?:noi|noi ve|ve) ", r"(?:khai niem|dinh nghia|giai thich) (?:cua|ve)? ?",
)
SUFFIXES = (r" (?:la gi|nghia la gi|la sao|nhu the nao|the nao)$", r" (?:o dau|trong kinh nao)$")
FILLERS = "cua ve la gi su cac nhung mot noi den trong".split()
DEFINITION = ("khai niem", "dinh nghia", "la gi", "giai thich")
PALI_LIKE, QUOTE_LEAST = 0.5, 3
CORPORA = ("mul", "att", "tik", "nrf")
PITAKAS = {"vinaya": ("vin",), "sutta": ("s",), "abhidhamma": ("abh",)}
TRANSLATION_WORDS, TRANSLATION_TERMS, TRANSLATION_ROWS = 6, 10, 80
TRANSLATION_STOPWORDS = set(
    "ai ấy bạn bị các cái cho có của đã đang đến đó được gì hay họ khi không kia là lại mà một này nên những nó rằng sẽ thì thế tôi trong từ và về vị với "
    "a an and are as at be by for from in is it of on or that the this to was were with".split()
)
LABELS = {"mul": "Tipiṭaka Mūla", "att": "Aṭṭhakathā", "tik": "Ṭīkā", "nrf": "Añña"}
NOT_SOURCES = ("Namo tassa bhagavato arahato sammāsambuddhassa", "Nidānavaṇṇanā niṭṭhitā.", "Paṭhamavaggavaṇṇanā niṭṭhitā.", "Dutiyavaggavaṇṇanā niṭṭhitā.")
CLOSING_MARKS = ("nitthita", "samatt")
HEADING_TAILS = "vaggo vagga nikayo nikaya pitaka pali patho suttam sutta suttavannana vannana katha niddeso niddesa nipato bhago".split()
SENTENCE_WORDS = "ti tattha vutta hoti yatha ettha iti".split()
HIDDEN_LEVELS = "pathamo dutiyo tatiyo catuttho pancamo chattho sattamo atthamo navamo dasamo".split()


@dataclass(frozen=True)
class Concept:
    """A notion with the words that call it and the terms that it stands for."""

    id: str
    label: str
    triggers: tuple[str, ...]
    pali: tuple[str, ...] = ()
    must: tuple[str, ...] = ()
    should: tuple[str, ...] = ()
    avoid: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()


def canonical(c: Column) -> Column:
    """A query without marks, polite beginnings, question endings and fillers; what is left of it if that is all."""
    plain = T.strip_marks(c)
    bare = T.squeeze(F.regexp_replace(plain, r"[^a-z0-9\s]", " "))
    cut = F.trim(F.regexp_replace(bare, "^(?:" + "|".join(PREFIXES) + ")+", ""))
    cut = reduce(lambda x, p: F.trim(F.regexp_replace(x, p, "")), SUFFIXES, cut)
    kept = F.array_join(F.filter(T.words(cut), lambda w: ~w.isin(FILLERS)), " ")
    return F.when(kept != "", kept).when(cut != "", cut).otherwise(plain)


def unique_folded(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, T.fold), lambda x: x != ""))


def _strings(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def analyze(rows: DataFrame, query: str, concepts: Sequence[Concept] = ()) -> DataFrame:
    """rows with `analysis`, a struct of 15 fields. concepts: a dictionary of bounded size, which goes into the plan."""
    q = F.col(query)
    rows = T.computed(rows, __clean=canonical(q), __plain=T.strip_marks(q), __ratio=T.latin_ratio(q), __segments=T.segments(q))
    both = F.concat(F.lit(" "), F.regexp_replace(F.when(F.col("__plain") == F.col("__clean"), F.col("__plain")).otherwise(F.concat_ws(" ", "__plain", "__clean")), r"\s", " "), F.lit(" "))

    def called(trigger: Column) -> Column:
        t = T.strip_marks(trigger)
        loose = F.contains(t, F.lit(" ")) | t.rlike("[က-႟]")  # words that no spaces part
        return F.when(loose, F.contains(both, t)).otherwise(F.contains(both, F.concat(F.lit(" "), t, F.lit(" "))))

    fields = ("triggers", "pali", "must", "should", "avoid", "phrases")
    known = [F.struct(F.lit(c.label).alias("label"), *(_strings(getattr(c, f)).alias(f) for f in fields)) for c in concepts]
    empty = f"array<struct<label:string,{','.join(f'{f}:array<string>' for f in fields)}>>"
    matched = F.filter(F.array(*known), lambda c: F.exists(c["triggers"], called)) if known else F.array().cast(empty)
    of = lambda f: F.flatten(F.transform("__matched", lambda c: c[f]))
    should = F.flatten(F.transform("__matched", lambda c: F.when(F.size(c["should"]) > 0, c["should"]).otherwise(c["pali"])))
    like, none = F.col("__ratio") >= PALI_LIKE, F.array().cast("array<string>")
    segments = F.when(like, F.col("__segments")).otherwise(none)
    terms = F.filter(F.transform(segments, lambda s: T.content_tokens(s)), lambda t: F.size(t) > 0)
    rows = rows.withColumn("__matched", matched)
    analysis = F.struct(
        q.alias("raw_query"), like.alias("is_pali_like"), F.when(like, T.content_tokens(q)).otherwise(none).alias("query_terms"), terms.alias("segment_terms"), unique_folded_all(segments).alias("segment_texts"),
        F.col("__clean").alias("clean_query"), F.when(reduce(lambda a, w: a | F.contains("__plain", F.lit(w)), DEFINITION, F.lit(False)), "definition").otherwise("search").alias("intent"),
        F.array_distinct(F.concat(T.tokens(F.col("__clean")), T.tokens(q))).alias("keywords"), F.transform("__matched", lambda c: c["label"]).alias("concepts"), unique_folded(of("pali")).alias("hints"), unique_folded(of("must")).alias("must"),
        unique_folded(F.concat(should, of("pali"))).alias("should"), unique_folded(of("avoid")).alias("avoid"), unique_folded(F.concat(F.array(q), of("phrases"))).alias("expanded"), T.long_stems(unique_folded(of("must"))).alias("stems"),
    )
    return rows.withColumn("analysis", analysis).drop("__clean", "__plain", "__ratio", "__segments", "__matched")


def unique_folded_all(values: Column) -> Column:
    """Folded, in order, repeats kept, empty ones left out."""
    return F.filter(F.transform(values, T.fold), lambda x: x != "")


def analysis_of(spark: SparkSession, query: str, concepts: Sequence[Concept] = ()) -> dict:
    """Of one query, as a dict: what the branches of a search are built from."""
    return analyze(spark.createDataFrame([(query,)], "q string"), "q", concepts).first()["analysis"].asDict(recursive=True)


def merged(local: dict, other: dict | None) -> dict:
    """An analysis with what an expansion adds: lists joined, each value once; its meaning and clean form win."""
    if not other:
        return local
    lists = ("keywords", "concepts", "hints", "exact_terms", "related_terms", "must", "should", "avoid", "expanded")
    out = local | {k: list(dict.fromkeys(str(x).strip() for x in [*(local.get(k) or []), *(other.get(k) or [])] if str(x).strip())) for k in lists}
    join = lambda *names: list(dict.fromkeys(x for n in names for x in out[n]))
    out |= {"hints": join("hints", "exact_terms", "related_terms"), "must": join("must", "exact_terms"), "should": join("should", "related_terms")}
    return out | {k: other.get(k) or local.get(k) for k in ("clean_query", "intent")}


def corpora(value: str | Sequence[str] | None) -> list[str]:
    """The corpora that a filter names; all if it names none that is known."""
    given = [value] if isinstance(value, str) else list(value or [])
    return list(CORPORA) if "all" in given else [x for x in given if x in CORPORA] or list(CORPORA)


def pitaka(value: str | None) -> str | None:
    """A known division, or no filter."""
    name = str(value or "").strip()
    return name if name in PITAKAS else None


def in_scope(file_name: Column, corpus: Column, wanted: Sequence[str], division: str | None) -> Column:
    """Documents of the corpora and, by their names' beginnings, of the division."""
    heads = PITAKAS.get(division or "", ())
    name = F.lower(file_name)
    return corpus.isin(*wanted) & (reduce(lambda a, h: a | F.startswith(name, F.lit(h)), heads, F.lit(False)) if heads else F.lit(True))


def basket(page_size: int, analysis: dict) -> int:
    """How many candidates a branch gives, whatever the page."""
    strong = bool(analysis.get("must") or analysis.get("exact_terms"))
    return max(150, page_size * 30) if strong else max(600, page_size * 80)


def rerank_window(top_score: float | None, analysis: dict, configured: int = 30) -> int:
    n = min(50, max(5, configured))
    strong = bool(analysis.get("must") or analysis.get("exact_terms"))
    return min(n, 30) if strong and top_score is not None and top_score >= 0.78 else n


def single_terms(terms: Iterable[str]) -> list[str]:
    """Terms of one word, sorted."""
    return sorted({t for t in terms if t and " " not in t})


def phrase_patterns(terms: Iterable[str]) -> list[str]:
    return sorted({f"%{t}%" for t in terms if " " in t})


def term_patterns(terms: Iterable[str]) -> list[str]:
    return [f"%{t}%" for t in single_terms(terms)]


def translation_terms(query: Column) -> Column:
    """struct(terms, n): the words that tell a text in a reader's language: all of two letters or more of a short query, the
    longest ones without stop words of a long one; n: its number of words."""
    found = F.transform(F.regexp_extract_all(query, F.lit(r"(\p{L}+)"), F.lit(1)), F.lower)
    unique = F.array_distinct(found)
    content = F.filter(unique, lambda w: (F.length(w) >= 3) & ~w.isin(sorted(TRANSLATION_STOPWORDS)))
    longest = F.transform(F.slice(F.array_sort(F.transform(content, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))), 1, TRANSLATION_TERMS), lambda x: x["w"])
    short = F.filter(unique, lambda w: F.length(w) >= 2)
    return F.struct(F.when(F.size(found) < TRANSLATION_WORDS, short).otherwise(longest).alias("terms"), F.size(found).alias("n"))


def source_key(c: Column) -> Column:
    """A label for comparison: no marks, punctuation but dots, dashes and brackets to spaces."""
    return T.squeeze(F.regexp_replace(T.strip_marks(c), r"[^\p{L}\p{N}_\s().-]", " "))


def source_noise(label: Column) -> Column:
    """Labels that are sentences or closing remarks, not names."""
    key = source_key(label)
    compact, spaced, words = F.replace(key, F.lit(" "), F.lit("")), F.concat(F.lit(" "), key, F.lit(" ")), F.size(F.split(key, " "))
    named = reduce(lambda a, t: a | F.endswith(compact, F.lit(t)), HEADING_TAILS, F.lit(False))
    marks = [F.contains(spaced, F.lit(("" if m == "ti" else " ") + m + " ")) for m in SENTENCE_WORDS]
    any_mark, dots = reduce(lambda a, m: a | m, marks), F.length(label) - F.length(F.replace(label, F.lit("."), F.lit("")))
    closing = reduce(lambda a, m: a | F.contains(key, F.lit(m)), CLOSING_MARKS, F.lit(False))
    long_ = F.length(label)
    sentence = (long_ > 90) & (sum(m.cast("int") for m in marks) >= 2)
    numbered = key.rlike(r"^\d+[.-]\s+") & ~named & ((long_ > 70) | (dots >= 2) | any_mark)
    ended = F.endswith(label, F.lit(".")) & ~named & ((words > 1) | any_mark)
    return (key == "") | closing | (long_ > 180) | sentence | numbered | ended | ((words > 18) & (dots >= 1))


def heading_title(label: Column) -> Column:
    """Short labels that end like a heading or begin with a number."""
    key = source_key(label)
    compact = F.replace(key, F.lit(" "), F.lit(""))
    named = reduce(lambda a, t: a | F.endswith(compact, F.lit(t)), HEADING_TAILS, F.lit(False))
    return ~source_noise(label) & (F.size(F.split(key, " ")) <= 10) & (named | key.rlike(r"^\(?\d+\)?\s+"))


def hidden_level(label: Column) -> Column:
    return source_key(label).rlike(rf"^\(?\s*(?:{'|'.join(HIDDEN_LEVELS)})\s+bhago\s*\)?$")


def clean_sources(path: Column) -> Column:
    """A source path without blank items, invocations and closing remarks."""
    kept = F.filter(F.transform(path, lambda x: F.trim(x)), lambda x: (x != "") & ~x.isin(*NOT_SOURCES))
    return F.filter(kept, lambda x: ~reduce(lambda a, m: a | F.contains(T.fold(x), F.lit(m)), CLOSING_MARKS, F.lit(False)))


def display_source(corpus: Column, section_path: Column, passage_path: Column) -> Column:
    """The corpus's name and the cleaned path: the section's, or the passage's own."""
    path = F.when(F.coalesce(F.size(section_path), F.lit(0)) > 0, section_path).otherwise(F.coalesce(passage_path, F.array().cast("array<string>")))
    return F.array_join(F.concat(F.array(T.lookup(corpus, LABELS)), clean_sources(path)), " -> ")


def paragraph_no(*numbers: Column) -> Column:
    """The first number that is not empty; an empty text if there is none."""
    return F.coalesce(*(F.when(n != "", n) for n in numbers), F.lit(""))
