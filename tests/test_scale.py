"""Operators for groups of any size, against brute force: exact signed ranks,
distributed scans, quantile selection, interval joins, cursor chains, upserts."""
import datetime as dt
import glob
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.operators.quantiles import exact_quantiles
from siftwork.operators.registry import upsert
from siftwork.operators.scan import Placed, average_ranks
from siftwork.operators.stats import bh_adjust, wilcoxon
from siftwork.operators.windows import join_windows
from siftwork.sources.pages import check_cursor_chain
from siftwork.sources.sinks import stored, upsert_bucketed


# ------------------------------------------------------------ signed ranks --

def test_exact_p_equals_enumeration(spark):
    r = random.Random(1)
    rows, want = [], {}
    for n in range(1, 13):
        diffs = [(k + 1) * r.choice([-1, 1]) / 8 for k in range(n)]
        r.shuffle(diffs)
        rows += [(n, d) for d in diffs]
        w = min(sum(abs(d) * 8 for d in diffs if s * d > 0) for s in (1, -1))
        sums = [sum(k + 1 for k in range(n) if up[k]) for up in itertools.product((0, 1), repeat=n)]
        want[n] = min(1.0, 2 * sum(s <= w for s in sums) / 2 ** n)
    got = wilcoxon(spark.createDataFrame(rows, "g int, diff double"), ["g"]).collect()
    assert {x["g"]: x["p_value"] for x in got} == pytest.approx(want)
    assert {x["p_method"] for x in got} == {"exact"}


def test_ties_zeros_and_many_differences_take_the_approximation(spark):
    rows = [("ties", d) for d in (1.0, -1.0, 2.0)] + [("zero", d) for d in (0.0, 1.0, -2.0)]
    rows += [("fifty", k * (-1.0) ** k) for k in range(1, 51)] + [("more", k * (-1.0) ** k) for k in range(1, 52)]
    rows += [(None, 1.0), (None, None), ("none", None), ("only zero", 0.0)]
    got = {r["g"]: r for r in wilcoxon(spark.createDataFrame(rows, "g string, diff double"), ["g"]).collect()}
    assert {g: r["p_method"] for g, r in got.items()} == {
        "ties": "normal", "zero": "normal", "fifty": "exact", "more": "normal", None: "exact"}
    assert got[None]["p_value"] == 1.0 and got[None]["n"] == 1
    assert got["fifty"]["p_value"] == pytest.approx(got["more"]["p_value"], abs=0.1)


# ------------------------------------------------------------------- scans --

def _hot(n=2000):
    """70 % of the rows in one group, null groups, many equal values."""
    r = random.Random(2)
    return [(i, "hot" if r.random() < 0.7 else r.choice(["a", None, "b"]), r.choice([0.0, 0.25, 0.5, r.random()])) for i in range(n)]


def test_scans_equal_windows_on_a_hot_group(spark):
    rows = _hot()
    df = spark.createDataFrame(rows, "id int, g string, x double").repartition(5)
    placed = Placed(df, ["g"], [F.col("x").asc(), F.col("id").asc()], parts=7)
    assert placed.df.where("g = 'hot'").select("_slice").distinct().count() > 2
    got = placed.running_sum("id", "s").total(F.lit(1), "n").suffix_min("id", "least").rows().collect()
    groups = {}
    for i, g, x in rows:
        groups.setdefault(g, []).append((x, i))
    want = {}
    for own in groups.values():
        ids = [i for _, i in sorted(own)]
        for k, i in enumerate(ids):
            want[i] = (sum(ids[:k + 1]), len(ids), min(ids[k:]))
    assert {r["id"]: (r["s"], r["n"], r["least"]) for r in got} == want


def test_average_ranks_and_bh_on_a_hot_group(spark):
    rows = _hot()
    df = spark.createDataFrame(rows, "id int, g string, x double").repartition(5)
    got = {(r["g"], r["x"]): (r["rank"], r["ties"]) for r in average_ranks(df, ["g"], "x", {}).collect()}
    by = {}
    for _, g, x in rows:
        by.setdefault(g, []).append(x)
    for g, xs in by.items():
        for x in set(xs):
            below, same = sum(y < x for y in xs), xs.count(x)
            assert got[g, x] == (below + (same + 1) / 2, same)
    adjusted = {r["id"]: r["p_adjusted"] for r in bh_adjust(df, "x", ["g"], ["id"]).collect()}
    for g in by:
        own = sorted((x, i) for i, h, x in rows if h == g)
        least = 1.0
        for k in range(len(own), 0, -1):
            least = min(least, own[k - 1][0] * len(own) / k)
            assert adjusted[own[k - 1][1]] == pytest.approx(least)
    assert bh_adjust(df.limit(0), "x", ["g"], ["id"]).count() == 0


# --------------------------------------------------------------- quantiles --

@pytest.mark.parametrize("bins", [64, 2048])
def test_quantiles_equal_percentile(spark, bins):
    r = random.Random(3)
    rows = [("hot", r.choice([1.0, 1.5, r.gauss(0, 1e6), 2.0 ** r.randrange(-300, 300), -0.1])) for _ in range(600)]
    rows += [(None, float(k)) for k in range(7)] + [("one", 4.25), ("same", 3.0), ("same", 3.0), ("null", None), ("hot", None)]
    rows += [("two", 1e308), ("two", -1e308)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {x["g"]: (x["n"], x["q"]) for x in exact_quantiles(df, ["g"], "x", probs, bins).collect()}
    want = {x["g"]: (x["n"], x["q"]) for x in df.groupBy("g").agg(
        F.count("x").alias("n"), F.percentile("x", F.array(*map(F.lit, probs))).alias("q")).collect()}
    assert got.pop("null") == (0, [None] * 6) and want.pop("null")[0] == 0
    assert got == want


def test_quantiles_of_nan_and_of_nothing(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 2.0), (2, 1.0)], "g int, x double")
    got = {r["g"]: r["q"] for r in exact_quantiles(df, ["g"], "x", [0.5]).collect()}
    assert np.isnan(got[1][0]) and got[2] == [1.0]
    assert exact_quantiles(df.limit(0), ["g"], "x", [0.5]).count() == 0
    assert exact_quantiles(df.where("g = 2"), [], "x", [0.5]).first()["q"] == [1.0]


# ----------------------------------------------------------------- windows --

def test_interval_join_equals_enumeration(spark):
    r = random.Random(4)
    day = lambda k: dt.date(1969, 6, 1) + dt.timedelta(days=k)
    spans = [(i, day(a := r.randrange(900)), day(a + r.choice([0, 0, 1, 7, 64, 300, 5000, -3]))) for i in range(60)]
    spans += [(60, None, day(3)), (61, day(3), None), (62, *spans[0][1:])]
    dates = [(i, day(r.randrange(-50, 1200))) for i in range(300)] + [(300, None), (301, dates_hot := day(100))] + [(400 + k, dates_hot) for k in range(200)]
    df, w = spark.createDataFrame(dates, "id int, d date"), spark.createDataFrame(spans, "w int, window_start date, window_end date")
    got = sorted((x["id"], x["w"]) for x in join_windows(df, "d", w).collect())
    assert got == sorted((i, k) for i, d in dates for k, a, b in spans if d and a and b and a <= d <= b)
    assert join_windows(df, "d", w.limit(0)).count() == 0 and join_windows(df.limit(0), "d", w).count() == 0


# ----------------------------------------------------------- cursor chains --

def naive_faults(pages):
    out = set()
    for g in {p[0] for p in pages}:
        link, count = {}, {}
        for _, cursor, nxt in (p for p in pages if p[0] == g):
            cursor = "*" if cursor is None else cursor
            count[cursor] = count.get(cursor, 0) + 1
            known = [x for x in (link.get(cursor), nxt) if x is not None]
            link[cursor] = min(known) if known else None
        out |= {(g, c, "doubled") for c, n in count.items() if n > 1}
        out |= {(g, n, "lost") for n in link.values() if n is not None and n not in link}
        seen, at = set(), "*"
        while at in link and at not in seen:
            seen.add(at)
            at = link[at]
        out |= {(g, c, "headless") for c in link if c not in seen}
        for c in link:
            passed, at = set(), c
            while at in link and at not in passed:
                passed.add(at)
                at = link[at]
            if at in passed:
                out.add((g, c, "looping"))
    return out


def test_cursor_chain_faults_equal_following_them(spark):
    r = random.Random(5)
    pages = []
    for g in ["whole", None, *(f"w{k}" for k in range(25))]:
        n = r.randrange(1, 12)
        own = [(g, "*" if k == 0 else f"c{k}", f"c{k + 1}" if k + 1 < n else None) for k in range(n)]
        if g != "whole":
            own = [p for p in own if r.random() < 0.9]
            own += [(g, p[1], r.choice([p[2], "c2", "*"])) for p in own if r.random() < 0.15]
        pages += own
    pages.append(("start", None, None))
    df = spark.createDataFrame(pages, "g string, cursor string, next_cursor string")
    got = check_cursor_chain(df, ["g"]).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == naive_faults(pages)
    assert not [x for x in got if x["g"] in ("whole", "start")]
    assert check_cursor_chain(df.limit(0), ["g"]).count() == 0


# ----------------------------------------------------------------- upserts --

def test_upsert_gives_one_answer_in_any_order(spark):
    base = spark.createDataFrame([(1, "old", 1), (None, "old", 1)], "k int, v string, n int")
    rows = [(1, "a", 1), (1, "b", 1), (None, "y", 1), (None, "x", 2)]
    want = None
    for order in itertools.permutations(rows):
        got = sorted(map(tuple, upsert(base, spark.createDataFrame(list(order), "k int, v string, n int"), ["k"]).collect()), key=str)
        want = want or got
        assert got == want
    assert sorted(want, key=str) == sorted([(1, "b", 1), (None, "x", 2)], key=str)      # n, then v: by column name


def test_bucketed_upsert_leaves_other_folders_alone(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    schema = "k int, v string, version int"
    first = spark.createDataFrame([(k, "a", 1) for k in range(200)] + [(None, "null", 1)], schema)
    assert upsert_bucketed(first, path, ["k"], 16, "version") == list(range(16))
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/_bucket=*/part-*")}
    before = files()
    new = spark.createDataFrame([(3, "b", 2), (3, "c", 2), (4, "late", 0), (None, "n2", 2), (1000, "new", 1)], schema)
    touched = upsert_bucketed(new, path, ["k"], 16, "version")
    after = files()
    assert 0 < len(touched) <= 4
    for f in before:
        assert (f in after) == (int(f.split("_bucket=")[1].split("/")[0]) not in touched)
    rows = {r["k"]: r["v"] for r in stored(spark, path).collect()}
    assert len(rows) == 202 == stored(spark, path).count()
    assert (rows[3], rows[4], rows[None], rows[1000], rows[5]) == ("c", "a", "n2", "new", "a")
    assert upsert_bucketed(new.limit(0), path, ["k"], 16, "version") == []
    upsert_bucketed(new, path, ["k"], 16, "version")                       # again: nothing changes
    assert {r["k"]: r["v"] for r in stored(spark, path).collect()} == rows


# --------------------------------------------------------------- streaming --

def test_ingest_goes_on_after_a_restart_and_keeps_null_keys_once(spark, tmp_dir):
    from siftwork.session import shared_folder
    from siftwork.streaming.landing import ingest_new_keys

    schema = "k int, v string"
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], schema)
    rows.write.parquet(f"{tmp_dir}/in")
    ingest = lambda: ingest_new_keys(spark, f"{tmp_dir}/in", rows.schema, f"{tmp_dir}/out", ["k"]).awaitTermination()
    ingest()
    assert sorted(map(str, stored(spark, f"{tmp_dir}/out").collect())) == sorted(map(str, [rows.collect()[0], rows.collect()[2]]))
    rows.write.mode("append").parquet(f"{tmp_dir}/in")
    ingest()
    assert stored(spark, f"{tmp_dir}/out").count() == 2
    # the checkpoint's place holds nothing of this application
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert glob.glob(f"{shared_folder(spark)}/ingest-*/offsets")


def test_least_from_the_end_is_a_running_one(spark):
    df = spark.range(200000).select("id", (F.col("id") * 7919 % 200003).alias("v"))
    least = Placed(df, [], [F.col("id").asc()], parts=1).suffix_min("v", "least")
    assert "unboundedfollowing" not in least.df._jdf.queryExecution().toString().lower()
    got = {r["id"]: r["least"] for r in least.rows().where("id % 20011 = 0").collect()}
    v = [i * 7919 % 200003 for i in range(200000)]
    assert got == {i: min(v[i:]) for i in range(0, 200000, 20011)}


def test_orders_meet_windows_by_the_day(spark, tmp_dir, monkeypatch):
    from siftwork.plans import scale_plans

    orders = [(i, dt.datetime(1996, 1 + i % 3, 5, i % 24)) for i in range(300)] + [(300, None), (None, dt.datetime(1996, 2, 5))]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_dir}/orders.parquet")
    spark.createDataFrame([(k,) for k in range(40)] + [(7,)], "s_suppkey long").write.parquet(f"{tmp_dir}/supplier.parquet")
    met = []
    monkeypatch.setattr(scale_plans, "join_windows", lambda df, *rest: met.append(df.count()) or join_windows(df, *rest))
    got = sorted(tuple(r) for r in scale_plans.QUERIES["window_join"](spark, tmp_dir).collect())
    want = []
    for k in range(40):
        start = dt.date(1994, 6, 1) + dt.timedelta(k * 37 % 2600)
        end = start + dt.timedelta(k % 3 if k % 5 == 0 else k * k % 1900)
        held = [i for i, t in orders if t and start <= t.date() <= end]
        if held:
            want.append((k, start, end, len(held) * (1 + (k == 7)), sum(i or 0 for i in held) * (1 + (k == 7))))
    assert got == want and met == [4]            # three days and the orders without one
