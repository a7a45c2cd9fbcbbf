"""Queries against their SQL on the smallest tables, and the driver's entry points."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ["screen_decisions", "normalize_messages", "gate_decisions", "scored_decisions", "components", "split_assignment", "heldout_eval", "stream_screen", "strict_csv_scan", "layout_precedence", "loss_history_long", "chat_template_marked", "chat_template_alternating", "stream_file_records", "stream_file_decisions"]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "conversations", "labels", "benchmark"):
        path = f"{SF}/{name}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in columns]
    key = lambda r: tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(key(r) for r in df.select(*columns).collect()) == sorted(key([r[i] for i in order]) for r in result.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_import_needs_no_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, check=True)


def test_arriving_files_come_in_parts(spark, duck, monkeypatch):
    """Files of larger tables are written and land in parts, by more tasks than files, with the same places and order."""
    from gristmill.plans import queries
    from gristmill.sources import tables

    monkeypatch.setattr(tables, "PART", 20_000)
    path = queries._landed(spark, SF)
    assert spark.read.text(f"{path}/in").selectExpr("_metadata.file_path").distinct().count() > 9
    names = ["part", "line", "error", "group_id"]
    want = duck.execute(f"select {', '.join(names)} from ({entry.oracle_sql()['stream_file_records']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in entry.queries()["stream_file_records"](spark, SF).select(*names).collect())
    seen = entry.queries()["stream_screen"](spark, SF).collect()
    assert len(seen) == spark.read.parquet(f"{SF}/documents.parquet").count()
