import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftwork.operators.stats import bh_adjust, normal_sf, paired, wilcoxon
from siftwork.operators.windows import assign_window, check_windows, date_windows, default_bounds


def test_default_windows(spark):
    w = date_windows(default_bounds(spark)).orderBy("window_id").collect()
    assert len(w) == 17
    assert (w[0]["window_start"], w[0]["window_end"]) == (dt.date(1990, 1, 1), dt.date(1991, 12, 31))
    assert (w[-1]["window_start"], w[-1]["window_end"]) == (dt.date(2022, 1, 1), dt.date(2022, 12, 31))
    assert check_windows(date_windows(default_bounds(spark))).count() == 0


def test_leap_day_start_has_no_gap(spark):
    b = spark.createDataFrame([(dt.date(2000, 2, 29), dt.date(2010, 1, 1))], "start date, end date")
    assert check_windows(date_windows(b, years=1)).count() == 0


def test_assign_window_matches_brute_force(spark):
    days = [dt.date(1989, 12, 31) + dt.timedelta(days=i * 37) for i in range(400)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = {r["d"]: (r["window_start"], r["window_end"]) for r in assign_window(df, "d").collect()}
    wins = [(r["window_start"], r["window_end"]) for r in date_windows(default_bounds(spark)).collect()]
    for d in days:
        want = [w for w in wins if w[0] <= d <= w[1]]
        assert got[d] == (want[0] if want else (None, None))


def test_bh_fixture(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.20)], "t string, p_value double")
    got = {r["t"]: r["p_adjusted"] for r in bh_adjust(df, order_key=["t"]).collect()}
    assert got["a"] == pytest.approx(0.04)
    assert got["b"] == pytest.approx(0.0533333333)
    assert got["c"] == pytest.approx(0.0533333333)
    assert got["d"] == pytest.approx(0.20)


def test_normal_sf(spark):
    import math
    df = spark.createDataFrame([(z,) for z in (0.0, 0.5, 1.0, 1.96, 3.0)], "z double")
    for r in df.select("z", normal_sf(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), abs=1e-7)


def test_wilcoxon_by_hand(spark):
    import math
    a = [0.5, 0.4, 0.9, 0.3, 0.6, 0.2, 0.7]
    b = [0.7, 0.4, 0.6, 0.5, 0.9, 0.4, 0.6]   # one zero difference, tied |d| = 0.2
    rows = [("db", f"t{i}", "T", x) for i, x in enumerate(a)] + [("db", f"t{i}", "O", x) for i, x in enumerate(b)]
    df = spark.createDataFrame(rows, "database string, review_id string, workflow string, recall double")
    res = wilcoxon(paired(df, ["database", "review_id"], "workflow", "T", "O", "recall"), ["database"]).first()
    d = [y - x for x, y in zip(a, b) if y - x != 0]
    ad = [abs(x) for x in d]
    ranks = [sum(1 for y in ad if y < x) + (sum(1 for y in ad if y == x) + 1) / 2 for x in ad]
    wp = sum(r for r, x in zip(ranks, d) if x > 0)
    wm = sum(r for r, x in zip(ranks, d) if x < 0)
    n = len(d)
    assert res["n"] == n and res["w_plus"] == pytest.approx(wp) and res["w_minus"] == pytest.approx(wm)
    ties = {}
    for x in ad:
        ties[x] = ties.get(x, 0) + 1
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(t ** 3 - t for t in ties.values()) / 48
    z = (min(wp, wm) - n * (n + 1) / 4) / math.sqrt(var)
    assert res["z"] == pytest.approx(z)
    assert res["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)
