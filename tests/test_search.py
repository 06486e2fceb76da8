"""Query texts, many queries in one scan, ranks by counting and bounded top-k, against plainer ways."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.functions.keyword import And, MeshTerm, Not, Or, QueryTextError, Term, compile_query, read_query
from siftwork.operators import counting
from siftwork.operators.counting import count_ranks
from siftwork.operators.postings import evaluate
from siftwork.operators.retrieval import QueryMatrix, cosine_rank, top_search

BOTH = ("title", "abstract")


@pytest.mark.parametrize("text, tree", [
    ("pcos", Term("pcos")),
    ('"polycystic ovar*"[tiab]', Term("polycystic ovar*")),
    ("hyper androgen*[ab]", Term("hyper androgen*", ("abstract",))),
    ("Polycystic Ovary Syndrome[mh] OR PCOS[ti]", Or(MeshTerm("polycystic ovary syndrome"), Term("pcos", ("title",)))),
    ("a AND b OR c", Or(And(Term("a"), Term("b")), Term("c"))),
    ("a OR b AND c", Or(Term("a"), And(Term("b"), Term("c")))),
    ("a NOT b AND c", And(And(Term("a"), Not(Term("b"))), Term("c"))),
    ("a AND NOT b", And(Term("a"), Not(Term("b")))),
    ("NOT (a OR b)", Not(Or(Term("a"), Term("b")))),
    ("(x) NOT (Animals[mh] NOT Humans[mh])", And(Term("x"), Not(And(MeshTerm("animals"), Not(MeshTerm("humans")))))),
    ('("polycystic" AND "ovary")', And(Term("polycystic"), Term("ovary"))),
    ('"AND" OR and', Or(Term("and"), Term("and"))),
])
def test_query_texts(text, tree):
    assert read_query(text) == tree


@pytest.mark.parametrize("text, at", [("", 0), ("a AND", 5), ("(a OR b", 0), ("a)", 1), ('say "x', 4), ("a[xx]", 1), ("OR a", 0),
                                      ('a OR ""', 5), ("a (b)", 2), ("a[", 1), ('a "b"', 2), ("*", 0)])
def test_faults_have_a_place(text, at):
    with pytest.raises(QueryTextError) as e:
        read_query(text)
    assert e.value.at == at


def _random_query(r, depth=0):
    if depth > 2 or r.random() < 0.4:
        words = ["a", "ab", "a*", "b", "poly-cystic", "ab*", "é", "x1", "(a", "c++", "a,b", "_"]
        text = " ".join(r.choice(words) for _ in range(r.choice([1, 1, 2, 3])))
        return MeshTerm(r.choice(["m", "n"])) if r.random() < 0.1 else Term(text, r.choice([BOTH, ("title",), ("abstract",)]))
    if r.random() < 0.25:
        return Not(_random_query(r, depth + 1))
    return r.choice([And, Or])(*[_random_query(r, depth + 1) for _ in range(r.choice([1, 2, 3]))])


def test_many_queries_equal_one_by_one(spark):
    r = random.Random(6)
    gaps = [" ", "  ", "\t", "-", ", ", "\n", "+", " (", ",", " "]
    text = lambda: "".join(r.choice(["a", "AB", "abc", "b", "poly", "cystic", "É", "x1", "c", "_"]) + r.choice(gaps) for _ in range(r.randrange(9)))
    rows = [(i, text() if r.random() < 0.9 else None, text() if r.random() < 0.9 else None, r.choice([["M"], ["n", "M"], [], None])) for i in range(150)]
    rows += [(None, "a b", "ab", None), (900, "", "", []), (901, "a b " * 20_000, "c", ["n"])]
    docs = spark.createDataFrame(rows, "id int, title string, abstract string, mesh array<string>").withColumn("query", F.lit(0)).repartition(3)
    queries = {f"q{k}": _random_query(r) for k in range(50)}
    got = sorted(map(tuple, evaluate(docs, "id", queries).collect()), key=str)
    each = docs.select("id", *[compile_query(q).alias(n) for n, q in queries.items()]).collect()
    assert got == sorted(((n, x["id"]) for n in queries for x in each if x[n]), key=str)
    assert evaluate(docs.limit(0), "id", queries).count() == 0


def test_many_queries_shuffle_nothing(spark):
    rows = [(1, "In the", "of the end"), (2, None, "the of"), (2, None, "the of"), (3, "th", None)]
    docs = spark.createDataFrame(rows, "id int, title string, abstract string")
    q = {"phrase": read_query('"in the" OR "of the"[ab]'), "prefix": read_query("th*[ab] AND NOT of"), "not": read_query("NOT the")}
    got = evaluate(docs, "id", q)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [("not", 3), ("phrase", 1)]
    again = spark.createDataFrame(rows[:1] * 2, docs.schema)         # rows that come twice
    assert sorted(map(tuple, evaluate(again, "id", {"phrase": q["phrase"]}).collect())) == [("phrase", 1)] * 2


# ------------------------------------------------------- ranks and top-k --

@pytest.fixture(scope="module")
def search(spark):
    r = np.random.default_rng(7)
    vecs = r.integers(-2, 3, (400, 4)).astype(float)                 # few directions: many equal similarities
    vecs[5:8] = 0
    docs = [(["db", "hot", "hot"][i % 3], i, f"id{i * 37 % 400}", v.tolist()) for i, v in enumerate(vecs)] + [("db", 500, "nil", None), ("db", 501, "short", [1.0])]
    space = spark.createDataFrame(docs, "database string, article_id int, original_id string, embedding array<double>").repartition(5)
    qs = [("topic", "one", f"r{k}", f"q{k}", db, r.integers(-2, 3, 4).astype(float).tolist()) for k in range(9) for db in ("db", "hot", "empty")]
    queries = spark.createDataFrame(qs, "scope string, shot string, review_id string, query_id string, database string, embedding array<double>")
    return queries, space


def _ranks(spark, queries, space):
    rows = cosine_rank(queries, space, dim=4, method="window").collect()
    return {(x["review_id"], x["database"], x["original_id"]): (x["rank"], x["cosine_similarity"]) for x in rows}


@pytest.mark.parametrize("block_bytes", [1 << 20, 1500])
def test_counted_ranks_equal_the_whole_ranking(spark, search, block_bytes, monkeypatch):
    queries, space = search
    monkeypatch.setattr(counting, "CELLS_PER_FRAME", 50)
    matrix = QueryMatrix.collect(queries, "database", ["scope", "shot", "review_id"], dim=4)
    want = _ranks(spark, queries, space)
    wanted = space.where("article_id % 4 < 2 or original_id in ('nil', 'short')").select("original_id", "database").join(
        matrix.queries.select("_q", "database"), "database").select("_q", "original_id")
    wanted = wanted.unionByName(wanted.limit(5))
    got = count_ranks(matrix, space, wanted, block_bytes=block_bytes).join(matrix.queries.select("_q", "review_id", "database"), "_q").collect()
    chosen = {x["original_id"] for x in space.where("article_id % 4 < 2").select("original_id").collect()}
    assert {(x["review_id"], x["database"], x["original_id"]): (x["rank"], x["cosine_similarity"]) for x in got} == {
        k: v for k, v in want.items() if k[2] in chosen}
    assert len(got) == len({(x["_q"], x["original_id"]) for x in got})
    assert count_ranks(matrix, space, wanted.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_top_search_equals_the_first_of_the_ranking(spark, search, k):
    queries, space = search
    want = {key: v for key, v in _ranks(spark, queries, space).items() if v[0] <= k}
    got = top_search(queries, space, k, dim=4).collect()
    assert {(x["review_id"], x["database"], x["original_id"]): (x["rank"], x["cosine_similarity"]) for x in got} == want
    assert len(got) == len(want)
