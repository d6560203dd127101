"""Every query of the text package over the smallest data, beside its SQL where it has one."""

import glob
import importlib.util
import os

import pytest

from threadloom.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(
    not os.path.isdir(DATA) or importlib.util.find_spec("duckdb") is None, reason="needs the test tables and DuckDB"
)

COLUMNS = {
    "p2_found": {"feature_id_a", "feature_id_b"},
    "p3_found": {"unit_id", "task", "label"},
    "p4_found": {"source_table", "row_key", "pii_type", "start_codepoint"},
    "p6_found": {"conversation_id", "turn_no", "message_id", "speaker_no"},
    "p8_ids": {"doc_id", "ids"},
    "p10_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    import duckdb

    got = QUERIES[name](spark, DATA).toPandas()
    assert COLUMNS.get(name, set(got.columns)) == set(got.columns)
    if name not in SQL:
        return
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(SQL[name]).df()
    cell = lambda v: "null" if v != v or v is None else str(round(float(v), 6)) if isinstance(v, (int, float)) else str(v)
    rows = lambda f: sorted(tuple(map(cell, r)) for r in f[sorted(f.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
