import pytest
from pyspark.sql import functions as F

from loomtext.functions import similarity as S
from loomtext.functions import text as T


def one(spark, expression, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(expression).first()[0]


@pytest.mark.parametrize("given, want", [("Dīghā  Rātti, CANDĀ!", "digha ratti canda"), ("le\u00adm\u200bon x", "lemon x"), ("  ", ""), ("a-b_c", "a-b_c"), (None, None)])
def test_fold(spark, given, want):
    assert one(spark, T.fold(F.col("x").cast("string")), x=given) == want
    if given:
        assert one(spark, T.fold(T.fold(F.col("x"))), x=given) == want


def test_compose_joins_decomposed_letters(spark):
    assert one(spark, T.fold(T.compose(F.col("x"))), x="ran\u0307ga\u0304") == "ranga"


@pytest.mark.parametrize("given, want", [("Đường về", "duong ve"), ("crème", "creme"), ("plain", "plain")])
def test_strip_marks(spark, given, want):
    assert one(spark, T.strip_marks(F.col("x")), x=given) == want


def test_segments(spark):
    assert one(spark, T.segments(F.col("x")), x="One two. Three\nfour five six; x") == ["One two", "four five six"]
    assert one(spark, T.segments(F.col("x")), x="word") == ["word"]
    assert one(spark, T.segments(F.col("x")), x="  ") == []


def test_tokens_and_ratio(spark):
    assert one(spark, T.content_tokens(F.col("x")), x="the dukkha and dukkha sati so") == ["dukkha", "sati"]
    assert one(spark, T.tokens(F.col("x")), x="Tìm bài kinh về Khổ 12") == ["kho", "12"]
    assert one(spark, T.latin_ratio(F.col("x")), x="abc đường") == 0.5


@pytest.mark.parametrize("given, want", [("XIV", 14), ("mcmxc", 1990), ("IIX", 10), ("abc", None)])
def test_roman(spark, given, want):
    assert one(spark, T.roman(F.col("x")), x=given) == want


def test_html(spark):
    assert one(spark, T.strip_tags(F.col("x")), x="<p>a  b</p><script>x</script><p>c &amp;lt; d<br>e</p>") == "a b\nc &lt; d\ne"


def test_helpers(spark):
    assert one(spark, T.looks_like_heading(F.col("x")), x="CHAPTER ONE") is True
    assert one(spark, T.strip_number(F.col("x")), x="(12.3) Title") == "Title"
    assert one(spark, T.elided_prefix(F.col("x")), x="this stands … rest") == "this stands"
    assert one(spark, T.elided_prefix(F.col("x")), x="whole") is None
    assert one(spark, T.numbers(F.col("x")), x="mn10-2") == [10, 2]
    assert one(spark, T.excerpt(F.col("x"), 5, F.lit(0.0)), x="abcdefghij") == "abcde"
    assert one(spark, T.punctuation_spacing(F.col("x")), x="a ,b") == "a, b"
    assert one(spark, T.position_in(F.lit(5), F.lit(0), F.lit(10))) == 0.5
    assert one(spark, T.artifacts(F.col("x")), x="a b�") == "a b"


def test_similarity(spark):
    assert one(spark, S.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert one(spark, S.trigram_similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert one(spark, S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)
    assert one(spark, S.path_is_prefix(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) is True
    assert one(spark, S.path_is_prefix(F.array().cast("array<string>"), F.array(F.lit("a")))) is False
    assert one(spark, S.edit_ratio(F.lit("abcd"), F.lit("abce"))) == 0.75


def test_composition_without_python(spark):
    import unicodedata

    texts = ["saṅkhārā", "tiếng Việt ộ ự", "é́ x", "plain", "й ё", "ぱ", "q́z", "line\nsāti", "", "ệ\u0301"]
    texts += [unicodedata.normalize("NFD", x) for x in texts] + ["o\u0302\u0323", "ô\u0323"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in df.select(T.composed(F.col("x"))).collect()] == [unicodedata.normalize("NFC", x) for x in texts]
    assert one(spark, T.fold(F.col("x")), x=unicodedata.normalize("NFD", "Saṅkhārā, Ñāṇa")) == "sankhara nana"


def test_a_computed_column_is_computed_once(spark):
    rows = T.computed(spark.createDataFrame([("A b",), (None,)], "x string"), y=T.fold(F.col("x")))
    plan = rows.filter(F.contains("y", F.lit("a"))).select(F.length("y"), F.upper("y"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("translate(") == 1 and [r["y"] for r in rows.collect()] == ["a b", None]
