"""The driver's contract, and every SQL text against its query on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
# A few of each kind; all of them take minutes.
SOME = ["onehop_forward", "triangle_cycle", "composite_edges", "set_all", "max_degree", "meta_edges", "paths3_unfiltered", "explosion_report", "edge_exists_inverse", "primary_category_groups"]


def _plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("" if r[i] is None else f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SOME + sorted(n for n in entry.oracle_sql() if n[0] == "p" and n[1].isdigit()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns) and _plain(df.collect(), df.columns) == _plain(cur.fetchall(), names)


def test_loops_of_rare_subjects(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/edges.parquet").filter("trim(subject) <> '' and trim(predicate) <> '' and trim(object) <> ''").drop("object")
    one = e.groupBy("subject").agg({"edge_row": "min"}).toDF("object", "edge_row")
    e.join(one, "edge_row", "left").fillna("no loop", ["object"]).write.parquet(f"{tmp_path}/edges.parquet")
    spark.read.parquet(f"{DATA}/nodes.parquet").write.parquet(f"{tmp_path}/nodes.parquet")
    expected = sorted((r["object"], r["edge_row"]) for r in one.collect())
    con = duckdb.connect()
    for t in ("edges", "nodes"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = entry.queries()["self_loops"](spark, str(tmp_path))
    assert len(expected) > 200 and sorted(map(tuple, got.select("n0", "edge_idx").collect())) == expected
    assert sorted(con.execute(f"select n0, edge_idx from ({entry.oracle_sql()['self_loops']})").fetchall()) == expected


def test_tables_of_every_column(spark):
    tags = {r["tag"] for r in entry.queries()["p3_all_tables"](spark, DATA).collect()}
    assert tags == {"edges", "category", "publications", "sources", "sources.upstream_resource_ids", "sources.source_record_urls"}


def test_entry(spark):
    assert entry.entry(spark).columns == ["n0", "n1", "n2", "e0", "e1"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(f"p{n}_found" in entry.queries() for n in range(1, 8))
