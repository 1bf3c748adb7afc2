"""The registered queries on the small tables: their columns, and their SQL where there is some."""

import glob
import math
import os

import duckdb
import pytest

from kinfold.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't there")
COLUMNS = {
    "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2": "page_id host path rule verdict",
    "op3": "doc_id fingerprint component_id",
    "op4": "query_id rank vec_id score",
    "op5": "doc_id held_out score predicted",
    "op6": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op9": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op10": "doc_id licence score via licence_dir",
}


def form(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, DATA)
    assert got.columns == COLUMNS[name.split("_")[0]].split()
    rows = got.collect()
    assert rows
    if name in queries.oracle_sql():
        duck = duckdb.connect()
        for path in glob.glob(f"{DATA}/*.parquet"):
            duck.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
        cursor = duck.execute(queries.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(got.columns)
        at = [names.index(c) for c in got.columns]
        assert sorted(tuple(map(form, r)) for r in rows) == sorted(tuple(form(r[i]) for i in at) for r in cursor.fetchall())
