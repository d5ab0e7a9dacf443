"""White space of any kind around target_id isn't part of the id (TESTDATA.md)."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions.values import bare
from lodestone.plans.graph import load_graph
from lodestone.plans.problems import edge_targets, p3_target_profile
from lodestone.streaming.counters import coupling_counts

from .conftest import rows
from .test_problem_queries import SF, canon, duck  # noqa: F401

#: Queries whose SQL, which takes off spaces only, has other rows at sf0.001 because of tabs.
TOUCHED = (
    "c_importance e_explain g_externals g_violations h_distributions h_environment h_external_usage h_graph_ends h_most_connected "
    "h_node_metrics i_dependents i_environment i_statistics n_package_reach p3_target_profile q_callees q_callers q_dependencies "
    "q_environment_variables q_references x_backward_reach x_files x_hotspots x_package_imports"
).split()


@pytest.fixture(scope="module")
def cleaned(duck):  # noqa: F811
    c = duck.cursor()
    c.execute("create schema cleaned")
    c.execute("create view cleaned.edges as select * replace (trim(target_id, chr(9) || ' ') as target_id) from main.edges")
    c.execute("set search_path = 'cleaned,main'")
    return c


def test_bare(spark):
    df = spark.createDataFrame([("a",), (" a\t",), ("\r\n a b \x0b\f",), ("\t",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(bare(F.col("x"))).collect()] == ["a", "a", "a b", "", "", None]


def test_every_target_is_a_node(spark):
    raw = spark.read.parquet(f"{SF}/edges.parquet")
    assert raw.where(r"target_id rlike '\\t'").count() > 0
    graph = load_graph(spark, SF)
    ids = graph.nodes.select("repo_id", F.col("id").alias("target_id"))
    assert graph.edges.join(ids, ["repo_id", "target_id"], "left_anti").count() == 0
    assert edge_targets(spark, SF).join(graph.nodes.select("id").distinct(), "id", "left_anti").count() == 0


def test_counts_of_targets(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/edges.parquet").select("repo_id", "id", "target_id").collect():
        want.setdefault(r.target_id.strip(), set()).add((r.repo_id, r.id))
    got = {r.id: r.edges for r in p3_target_profile(spark, SF).collect()}
    assert got == {k: len(v) for k, v in want.items()}


def test_counter(spark, tmp_path):
    df = spark.createDataFrame([(1, "e1", "a\t"), (1, "e2", " a"), (1, "e3", "b")], "repo_id bigint, id string, target_id string")
    df.withColumn("arrived", F.lit("2031-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = coupling_counts(spark.readStream.schema("repo_id bigint, id string, target_id string, arrived timestamp").parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("blanks").outputMode("complete").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    assert rows(spark.table("blanks")) == [(1, "a", 2), (1, "b", 1)]


@pytest.mark.parametrize("name", TOUCHED)
def test_same_as_sql_over_clean_targets(spark, cleaned, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(canon(r[c]) for c in cols)) for r in df.collect())
    res = cleaned.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert got == Counter(repr(tuple(canon(r[names.index(c)]) for c in cols)) for r in res.fetchall())
