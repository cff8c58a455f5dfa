"""Every registered query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lattica.plans.named import NAMED, run
from lattica.plans.views import Store

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The operators of the optional folder have tests of their own.
NAMES = [n for n in entry.queries() if n != "pipeline" and not n.startswith("op")]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    out = entry.queries()[name](spark, SF)
    columns = sorted(out.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in out.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    res = db.sql(sql)
    assert sorted(res.columns) == columns
    at = [res.columns.index(c) for c in columns]
    assert sorted(rows, key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "similarity" in out.columns


def test_only_equal_edges_are_dropped(spark):
    rows = [(1, 2, "import", "b"), (1, 2, "import", "a"), (1, 2, "call", "c"), (51, 2, "import", "d"), (1, 52, "import", "e"), (51, 52, "import", "f"), (51, 52, "import", "f")]
    edges = spark.createDataFrame(rows, "source_id long, target_id long, type string, import_content string")
    got = [tuple(r) for r in Store(spark, SF).sql(NAMED["w5_keep_first_relationship"], relationships=edges).collect()]
    assert sorted(got) == [(1, 2, "call", "c"), (1, 2, "import", "a"), (1, 52, "import", "e"), (51, 2, "import", "d"), (51, 52, "import", "f")]


def test_tasks_that_begin_alike_stay_apart(spark, tmp_path):
    same = "x" * 40
    rows = [(1, 0, "user", same + " one"), (1, 1, "assistant", same + " two"), (2, 0, "user", same + " three"), (3, 0, "user", same.upper() + "  one")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["id"], r["description"]) for r in entry.queries()["z39_distinct_tasks"](spark, str(tmp_path)).collect()}
    assert got == {(100, same + " one"), (200, same + " three")}
    assert Store(spark, str(tmp_path))["incoming_connections"].first()["description"] == same + " two"


def test_changes_are_told_by_text(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (5, "c"), (6, None), (9, "gone")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (5, "c"), (6, "now"), (13, "new")], "doc_id long, text string")
    got = {n: {r["doc_id"] for r in Store(spark, SF).sql(NAMED[n], old_documents=old, new_documents=new).collect()} for n in ("u4_deleted_files", "u5_changed_or_new")}
    assert got == {"u4_deleted_files": {9}, "u5_changed_or_new": {2, 6, 13}}


def test_files_at_either_end_of_a_mapping(spark):
    sides = "id long, file_id long"
    out = spark.createDataFrame([(1, 7), (2, 7), (3, None)], sides)
    inc = spark.createDataFrame([(1, 7), (2, 8), (3, None)], sides)
    pairs = [(i, s, r, c) for i, (s, r, c) in enumerate([(1, 1, 0.9), (1, 2, 0.9), (2, 1, 0.5), (3, 2, 0.7), (3, 3, 0.7), (9, 1, 0.7), (2, None, 0.8)])]
    maps = spark.createDataFrame(pairs, "id long, sender_id long, receiver_id long, match_confidence double")
    got = Store(spark, SF).sql(NAMED["p5_disjunctive_filter"], outgoing_connections=out, incoming_connections=inc, connection_mappings=maps).collect()
    assert sorted((r["file_id"], r["id"]) for r in got) == [(7, 0), (7, 1), (7, 5), (7, 6), (8, 1), (8, 3)]


def test_suffixes_are_keys(spark):
    store = Store(spark, SF)
    store._made["files"] = spark.createDataFrame([(1, "/r/A/x.py"), (2, "/r/b/x.py"), (3, "x.py"), (4, "/r/ax.py"), (5, None)], "id long, file_path string")
    at = lambda suffix: {r["id"] for r in run(store, "p8_suffix_path", suffix=suffix).collect()}
    assert (at("x.py"), at("a/x.py"), at("/r/a/x.py"), at("y.py")) == ({1, 2, 3}, {1}, {1}, set())


def test_snapshot_changes_by_text(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (6, None), (7, None), (9, "gone")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (6, "now"), (7, None), (13, "new")], "doc_id long, text string")
    got = Store(spark, SF).sql(NAMED["j28_snapshot_compare"], old_documents=old, new_documents=new).collect()
    assert {r["doc_id"]: r["change"] for r in got} == {1: "unchanged", 2: "changed", 6: "changed", 7: "unchanged", 9: "deleted", 13: "new"}
