from pyspark.sql import functions as F

from digest_spark.functions import text
from digest_spark.functions.html import text_of
from digest_spark.functions.similarity import ratio


def values(spark, rows, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(expr).collect()]


def test_normalize_title(spark):
    rows = ["Foo  bar - baz | Pub", "A - " + "x" * 40, "A - " + "x" * 41, None, "  ", "One two"]
    assert values(spark, rows, text.normalize_title(F.col("x"))) == ["foo bar baz", "a", "a - " + "x" * 41, "", "", "one two"]


def test_clean_title(spark):
    rows = [("T - P - x - P", "P"), ("T", "P"), ("T - Fonte desconhecida", None), (None, "P")]
    assert values(spark, rows, text.clean_title(F.col("t"), F.col("p")), "t string, p string") == ["T - P - x", "T", "T", "Sem título"]


def test_format_published(spark):
    rows = ["Mon, 05 Aug 2024 01:00:00 GMT", "Mon, 5 Aug 2024 1:00:00 UTC", "Mon, 05 Aug 2024 01:00:00 -0300", "", None, "soon"]
    assert values(spark, rows, text.format_published(F.col("x"))) == ["04/08/2024 22:00"] * 2 + [rows[2], "Data não disponível", "Data não disponível", "soon"]


def test_relevant_ids(spark):
    rows = ["NULL", "null.", "0, 2, 2", "99", "-1", "", None, "99999999999"]
    assert values(spark, rows, text.parse_relevant_ids(F.col("x"))) == [[], [], [0, 2, 2], [99], [1], [], None, []]


def test_gates(spark):
    rows = ["x" * 300, "x" * 301, "x" * 2501]
    assert values(spark, rows, F.length(text.gate_text(F.col("x")))) == [None, 301, 2500]
    assert values(spark, ["d" * 80, "d" * 81, None], F.length(text.text_or_description(F.lit(None), F.col("x")))) == [None, 81, None]
    assert values(spark, ["application/PDF", "image/png", None, "text/html"], text.is_text_content(F.col("x"))) == [False, False, True, True]
    assert values(spark, ["Reator novo", None, "SHOW", "ok"], text.has_any_word(F.col("x"), text.NEGATIVE_WORDS)) == [True, False, True, False]


def test_keys_and_terms(spark):
    assert values(spark, ['"a OR b" OR "c"', "", '"x'], text.extract_terms(F.col("x"))) == [["a OR b", "c"], [], []]
    term, lang = text.split_topic_key(F.col("x"))
    assert values(spark, ["a|en", "a", "a|b|en"], F.concat_ws("/", term, lang)) == ["a/en", "a/pt", "a/b"]
    assert values(spark, [' "A "b" c"" \n'], text.clean_summary(F.col("x"))) == ['A "b" c']


def test_html_text():
    assert text_of("<!DOCTYPE html><title>T</title><nav>n<ul><li>x</ul></nav><p>a <b>b</b>&amp;c</p><!-- no --><script>s</script> <br>d") == "T a b &c d"
    assert text_of("<div><nav>never closed <p>x</p></div><p>after</p>") == "after"
    assert text_of("<form>a<form>b</form>c</form>d") == "d"
    assert text_of("x </nav> y") == "x y"
    assert text_of(None) is None and text_of("") == ""


def test_ratio_is_not_symmetric():
    assert (ratio("tide", "diet"), ratio("diet", "tide")) == (0.25, 0.5)
