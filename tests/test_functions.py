import pytest
from pyspark.sql import functions as F

from siftwork.functions import (And, Not, Or, Term, clean_html, clean_id, clean_year, compile_query,
                                decode_inverted_index, f_beta, fix_question_id, signif,
                                std_question_id)


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize("raw,expected", [
    ("https://openalex.org/W123", "w123"), ("  HTTPS://OPENALEX.ORG/W9 ", "w9"),
    (" w1 ", "w1"), ("", None), (None, None), ("\tAB12\n", "ab12"),
])
def test_clean_id(spark, raw, expected):
    assert one(spark, clean_id(F.col("x")), raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("2019//", 2019), ("/2020/", 2020), ("2021,03", 2021), ("2015.0", 2015), ("2015.5", None),
    ("", None), ("nan", None), ("None", None), ("NaT", None), ("abcd", None), ("1989", 1989),
    (" 2022 ", 2022), (None, None),
])
def test_clean_year(spark, raw, expected):
    assert one(spark, clean_year(F.col("x")), raw) == expected


@pytest.mark.parametrize("raw,slash,comma", [
    ("1.4.1, 1.4.2", "1.4.1/1.4.2", "1.4.1,1.4.2"),
    ("1.10.", "1.10", "1.10"),
    ("1.10.1", "1.10.1", "1.10.1"),          # not 1.101 (literal replace quirk)
    ("4.2 / 4.3", "4.2/4.3", "4.2,4.3"),
    ("Q1.2", "q1.2", "Q1.2"),
])
def test_question_ids(spark, raw, slash, comma):
    assert one(spark, fix_question_id(F.col("x")), raw) == slash
    assert one(spark, std_question_id(F.col("x")), raw) == comma


def test_decode_inverted_index(spark):
    df = spark.createDataFrame([({"the": [0, 3], "cat": [1], "sat": [2], "mat": [4]},)],
                               "m map<string, array<int>>")
    assert df.select(decode_inverted_index("m").alias("t")).first()["t"] == "the cat sat the mat"


@pytest.mark.parametrize("x,digits,expected", [
    (0.0123456, 4, 0.01235), (1234.56, 4, 1235.0), (0.0, 4, 0.0), (-0.00098765, 2, -0.00099),
])
def test_signif(spark, x, digits, expected):
    got = one(spark, signif(F.col("x"), digits), x, "x double")
    assert got == pytest.approx(expected, rel=1e-12)


def test_f_beta(spark):
    df = spark.createDataFrame([(0.4, 0.5), (0.0, 0.0)], "p double, r double")
    rows = df.select(*[f_beta("p", "r", b).alias(f"f{b}") for b in (1, 2, 3)]).collect()
    assert rows[0]["f1"] == pytest.approx(0.444444, abs=1e-6)
    assert rows[0]["f2"] == pytest.approx(0.476190, abs=1e-6)
    assert rows[0]["f3"] == pytest.approx(0.487805, abs=1e-6)
    assert (rows[1]["f1"], rows[1]["f2"], rows[1]["f3"]) == (0.0, 0.0, 0.0)


def test_clean_html(spark):
    v = "<p>Insulin &lt;b&gt;resistance&lt;/b&gt;   in <i>women</i>&amp;more</p>"
    assert one(spark, clean_html(F.col("x")), v) == "Insulin resistance in women &more"


def test_keyword_query(spark):
    rows = [(1, "Insulin resistance in women", None), (2, "Metformin trial in mice", "x"),
            (3, "metformin and diet", "insulin resistant"), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, title string, abstract string")
    q = Or(Term("insulin resist*"), And(Term("metformin"), Not(Term("mice"))))
    got = {r["id"] for r in df.where(compile_query(q)).collect()}
    assert got == {1, 3}


def test_inverted_index_round_trip(spark):
    from siftwork.functions import with_inverted_index
    rows = [(1, "the cat sat the mat"), (2, ""), (3, "  a\n b   a ")]
    df = with_inverted_index(spark.createDataFrame(rows, "id int, text string"), "text", "m")
    got = {r["id"]: (r["m"], r["t"]) for r in df.select("id", "m", decode_inverted_index("m").alias("t")).collect()}
    assert got[1][0] == {"the": [0, 3], "cat": [1], "sat": [2], "mat": [4]}
    assert got[1][1] == "the cat sat the mat"
    assert got[2][1] == ""
    assert got[3][1] == "a b a"


def test_clean_html_keeps_comparisons(spark):
    for text, want in [
        ("HbA1c &lt; 7% in women and BMI &gt; 30 kg", "HbA1c < 7% in women and BMI > 30 kg"),
        ("p < 0.05 in 40 arms, n > 100", "p < 0.05 in 40 arms, n > 100"),
        ("a<!-- a > b -->c", "a c"),
        ("x &amp; y &#233; &#x1F600; &copy &nosuch; &", "x & y é \U0001F600 © &nosuch; &"),
        ("&lt;b&gt;bold&lt;/b&gt;<br/>end<?xml v?>", "bold end"),
    ]:
        assert one(spark, clean_html(F.col("x")), text) == want


def test_p_text(spark):
    from siftwork.operators.stats import p_text

    assert one(spark, p_text(F.col("x").cast("double")), "0.01") == "<0.01"
    assert one(spark, p_text(F.col("x").cast("double")), "0.014") == "0.014000"


def test_references_equal_the_standard_library(spark):
    import html
    import random
    from html.entities import html5

    from siftwork.functions.text import unescape_entities

    r = random.Random(1)
    cases = ["5&#150;10 mg", "&notit;", "AT&ampT", "&copy2020", "&#00000150;z", "&#0;", "&#x0D;", "&#55296;", "&#1114112;", "&#99999999999999;", "&#8;", "&#xFDD0;",
             "&Amp;", "&", "&;", "&#;", "&#x;", "&amp;lt;", "&#65534;", "&&amp;", "&é;", "&" + "a" * 40 + ";", "", None]
    cases += [r.choice(["", "x"]) + "&" + r.choice(list(html5)) + r.choice(["", ";", "a", "2", " "]) for _ in range(500)]
    cases += ["&#" + r.choice(["", "x", "X"]) + "".join(r.choice("0123456789abcF") for _ in range(r.randrange(1, 8))) + r.choice(["", ";", "z"]) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, x string").select("x", unescape_entities("x").alias("y")).collect()
    assert [(x["x"], x["y"]) for x in rows if x["y"] != (None if x["x"] is None else html.unescape(x["x"]))] == []


def test_words_and_positions_are_sorted_without_a_lambda(spark):
    from siftwork.functions import with_inverted_index

    texts = [(1, "b a  b\tc a b"), (2, ""), (3, None), (4, " é Z z é ")]
    d = with_inverted_index(spark.createDataFrame(texts, "id int, text string"), "text")
    out = d.select("id", "abstract_inverted_index", decode_inverted_index("abstract_inverted_index").alias("abstract"))
    assert "array_sort" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r for r in out.collect()}
    assert {i: r["abstract"] for i, r in got.items()} == {1: "b a b c a b", 2: "", 3: None, 4: "é Z z é"}
    assert got[1]["abstract_inverted_index"] == {"a": [1, 4], "b": [0, 2, 5], "c": [3]}
    gaps = spark.createDataFrame([({"x": [9, 2], "y": [5, 2]},)], "i map<string,array<int>>")
    assert gaps.select(decode_inverted_index("i")).first()[0] == "x y y x"
