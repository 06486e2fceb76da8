"""The queries' DuckDB twins on the smallest tables, and their columns."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from siftwork.llm.oracles import ORACLES
from siftwork.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")

COLUMNS = {
    "op1_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_records": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op5_html": "page_id bigint, url string, text string, n_chars bigint",
    "op6_substring": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_urls": "page_id bigint, host string, path string, rule string, verdict string",
    "op11_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op12_merkle": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op13_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op10_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
}


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(COLUMNS) | {"pipeline"} == set(QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = entry.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    for c in COLUMNS[name].split(", "):
        column, kind = c.split(" ")
        assert kinds[column] == kind
    if name in ("op11_packing", "op13_collocations"):          # rows are pieces, or phrases
        assert df.count() > 0
        return
    table = "pages" if name in ("op5_html", "op9_urls") else "documents"
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(cur.fetchall())
