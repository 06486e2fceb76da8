import json
import os

from pyspark.sql import functions as F

from siftwork.sources import (read_landed_pages, read_tagged_records, strategy_from_file_name,
                              write_per_question)
from siftwork.sources.sinks import stage

RIS_A = ("TY  - JOUR\r\nTI  - First title\r\nAU  - Smith, A\r\nAU  - Jones, B\r\n"
         "AB  - An abstract that\r\n  continues on a second line\r\nZZ  - unknown tag\r\n"
         "AN  - 1001\r\nPY  - 2019//\r\nER  - \r\n"
         "TY  - JOUR\r\nTI  - OVARIAN CANCER  - a review\r\nAN  - 1002\r\nPY  - 2020\r\nER  - \r\n")
RIS_B = "TY  - JOUR\nTI  - Part two\nAN  - 1003\nPY  - 2021\nER  - \nTY  - JOUR\nTI  - No end tag\nAN  - 1004\n"


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


def test_ris_reader(spark, tmp_dir):
    _write(f"{tmp_dir}/gdg1_12_embase-1.ris", RIS_A)
    _write(f"{tmp_dir}/gdg1_12_embase-2.ris", RIS_B)
    _write(f"{tmp_dir}/gdg4_2_4_3_combined_embase-1.ris", "TY  - JOUR\nTI  - Combined\nAN  - 2001\nER  - \n")
    _write(f"{tmp_dir}/_excluded_questions/gdg3_2_embase.ris", "TY  - JOUR\nTI  - skip me\nAN  - 9\nER  - \n")
    rows = {r["accession_number"]: r for r in read_tagged_records(spark, tmp_dir).collect()}
    assert set(rows) == {"1001", "1002", "1003", "1004", "2001"}
    a = rows["1001"]
    assert a["primary_title"] == "First title"
    assert a["authors"] == ["Smith, A", "Jones, B"]
    assert a["notes_abstract"] == "An abstract that continues on a second line"
    assert a["publication_year"] == "2019//"
    assert rows["1002"]["primary_title"] == "OVARIAN CANCER  - a review"
    assert rows["1004"]["primary_title"] == "No end tag"
    assert {rows[k]["question_id"] for k in ("1001", "1003")} == {"1.12"}
    assert rows["2001"]["question_id"] == "4.2/4.3"
    assert "ZZ" not in rows["1001"].asDict()


def test_landed_pages(spark, tmp_dir):
    page1 = {"meta": {"next_cursor": "abc"}, "results": [
        {"id": "https://openalex.org/W1", "ids": {"openalex": "W1", "doi": "d1", "pmid": None},
         "title": "t1", "publication_year": 2019, "type": "article",
         "abstract_inverted_index": {"the": [0, 3], "cat": [1], "sat": [2], "mat": [4]},
         "primary_topic": {"id": "T1", "display_name": "x"}},
        {"id": "https://openalex.org/W2", "ids": None, "title": "t2", "publication_year": 2020,
         "type": "review", "abstract_inverted_index": None, "primary_topic": None}]}
    page2 = {"meta": {"next_cursor": None}, "results": [
        {"id": "https://openalex.org/W2", "title": "t2", "publication_year": 2020, "type": "review"}]}
    _write(f"{tmp_dir}/oa_1990-01-01_1991-12-31_p1.json", json.dumps(page1))
    _write(f"{tmp_dir}/oa_1990-01-01_1991-12-31_p2.json", json.dumps(page2))
    rows = read_landed_pages(spark, tmp_dir).collect()
    assert len(rows) == 3
    w1 = [r for r in rows if r["id"].endswith("W1")][0]
    assert w1["abstract"] == "the cat sat the mat" and w1["doi"] == "d1" and w1["topic_id"] == "T1"
    assert str(w1["window_start"]) == "1990-01-01" and str(w1["window_end"]) == "1991-12-31"
    assert {r["next_cursor"] for r in rows} == {"abc", None}


def test_strategy_from_file_name(spark):
    names = ["oa_topic_consolidated_boolkw_search_results.parquet",
             "embase_overarching_consolidated_topic_search_results.parquet"]
    df = spark.createDataFrame([(n,) for n in names], "f string").select(strategy_from_file_name("f").alias("s"))
    got = [tuple(r["s"]) for r in df.collect()]
    assert got[0] == ("openalex", "topic-specific", "boolean-kw")
    assert got[1] == ("embase", "overarching", "openalex-topic-search")


def test_sinks(spark, tmp_dir):
    df = spark.createDataFrame([("1.4.1/1.4.2", "raw", 1), ("2.1", "adjusted", 2)],
                               "question_id string, truth_kind string, v int")
    write_per_question(df, f"{tmp_dir}/out")
    keys = {r["question_key"] for r in spark.read.parquet(f"{tmp_dir}/out").collect()}
    assert keys == {"1_4_1_1_4_2", "2_1"}
    calls = []

    def build():
        calls.append(1)
        return df

    stage(spark, f"{tmp_dir}/stage", build)
    stage(spark, f"{tmp_dir}/stage", build)
    stage(spark, f"{tmp_dir}/stage", build, refresh=True)
    assert len(calls) == 2


def test_folder_and_review_helpers(spark, tmp_dir):
    from siftwork.operators.quality import check_min_rows
    from siftwork.sources.tables import for_review, read_folder, review_ids
    import pandas as pd
    os.makedirs(f"{tmp_dir}/res", exist_ok=True)
    pd.DataFrame({"id": ["x"], "v": [1]}).to_parquet(f"{tmp_dir}/res/oa_consolidated_a.parquet")
    pd.DataFrame({"id": ["y"], "w": [2.0], "z": ["extra"]}).to_parquet(f"{tmp_dir}/res/oa_consolidated_b.parquet")
    with open(f"{tmp_dir}/res/notes.txt", "w") as f:
        f.write("not a table")
    got = read_folder(spark, f"{tmp_dir}/res")
    assert set(got.columns) == {"id", "v", "w", "z"} and got.count() == 2
    strategies = spark.createDataFrame([("1.1", 2), ("1.2", 2), ("overall", 1), ("1.1", 2)],
                                       "evidence_review_id string, search_type_id int")
    types = spark.createDataFrame([(1, "overarching"), (2, "topic-specific")], "search_type_id int, name string")
    assert {r[0] for r in review_ids(strategies, types, "topic-specific").collect()} == {"1.1", "1.2"}
    assert for_review(strategies, "overall").count() == 4
    assert for_review(strategies, "1.1").count() == 2
    assert check_min_rows(strategies, 5, "search_strategies").count() == 1
    assert check_min_rows(strategies, 4).count() == 0


def test_append_new_is_idempotent_per_key(spark, tmp_dir):
    from siftwork.sources.sinks import append_new, stage, stored

    path = f"{tmp_dir}/t"
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k int, v string")
    assert stored(spark, path) is None
    assert append_new(rows, path, ["k"], spark) == 3
    assert append_new(rows, path, ["k"], spark) == 0
    assert stored(spark, path).count() == 3
    built = []
    for _ in range(2):
        assert stage(spark, f"{tmp_dir}/s", lambda: built.append(1) or rows).count() == 4
    assert built == [1]


def test_write_table_run_append_and_csv(spark, tmp_dir):
    from siftwork.sources.sinks import write_table
    from siftwork.sources.tables import read_table

    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    for run in ("r1", "r2"):
        write_table(rows, f"{tmp_dir}/p", mode="append", run_id=run)
    assert sorted(r["run_id"] for r in spark.read.parquet(f"{tmp_dir}/p").collect()) == ["r1", "r2"]
    write_table(rows, f"{tmp_dir}/c", fmt="csv")
    assert spark.read.option("header", True).csv(f"{tmp_dir}/c").collect()[0]["v"] == "a"


def test_topic_window_filter_on_landed_columns(spark):
    from siftwork.sources.pages import topic_window_filter

    rows = spark.sql("""SELECT * FROM VALUES ('T1', 'article', DATE'2020-05-01'), ('T1', 'book', DATE'2020-05-01'),
        ('T2', 'article', DATE'2020-05-01'), ('T1', 'article', DATE'2019-01-01') AS t(topic_id, type, publication_date)""")
    assert topic_window_filter(rows, ["T1"], start="2020-01-01", end="2020-12-31").count() == 1


def test_write_sorted_orders_the_files(spark, tmp_dir):
    import glob

    import pyarrow.parquet as pq

    from siftwork.sources.sinks import write_sorted

    write_sorted(spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(4), f"{tmp_dir}/o", ["v"])
    got = [v for f in sorted(glob.glob(f"{tmp_dir}/o/part-*")) for v in pq.read_table(f).column("v").to_pylist()]
    assert got == list(range(1000))
