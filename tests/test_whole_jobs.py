"""Queries that cover their whole input."""

from hashlib import sha256

from evidara.operators import retrieval
from evidara.plans.catalogue import QUERIES
from evidara.sources import tables


def test_every_token_counts(spark, tmp_path):
    texts = ["one two three four five six", "one two three four five seven"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.digest for r in QUERIES["x1_tokens"](spark, str(tmp_path)).collect()}
    assert got == {i: sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}


def test_few_queries_cannot_be_compared(spark):
    got = {r.verdict: r.queries for r in QUERIES["y8_compare_runs"](spark, "/root/testdata/sf0.1").collect()}
    assert got["UNCOMPARABLE"] * 4 <= sum(got.values()) and got["IMPROVED"] and got["REGRESSED"] and got["UNCHANGED"]


def test_ids_and_query_vectors_are_dealt_out(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    ids = QUERIES["j1_message_counts"](spark, "/root/testdata/sf0.001")
    assert "Generate" not in plan(ids) and "Range" in plan(ids)
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id < 8").toDF("query_id", "query_vector")
    got = retrieval.vector_top(vectors, queries, 1)
    assert "Broadcast" not in plan(got) and "CartesianProduct" in plan(got)
    assert {r.query_id for r in got.collect()} == set(range(8))


def test_tasks_of_the_three_way_check_hold_no_more_of_a_larger_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 500, raising=False)
    got = QUERIES["j14_three_way_check"](spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() >= spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500
    # orders and customers that stand twice, and keys, lines and statuses that are null or odd, change nothing
    odd = [-1, 0, 64, 65, 1 << 40, None]
    lines = [(k, n, "F") for k in (1, 2, 3, None) for n in odd] + [(1, 64, "O"), (2, 0, None)] + [(4, n, None) for n in odd] + [(5, n, "F") for n in odd[1:]]
    for name, rows, schema in (("lineitem", lines, "l_orderkey long, l_linenumber long, l_linestatus string"), ("orders", [(1, 7), (2, 7), (2, 7), (3, 8), (4, 9), (5, 9), (None, 7), (6, None)], "o_orderkey long, o_custkey long"), ("customer", [(7, 1.0), (7, 2.0), (8, 0.0), (9, 3.0), (None, 1.0)], "c_custkey long, c_acctbal double")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert sorted(map(tuple, QUERIES["j14_three_way_check"](spark, str(tmp_path)).collect())) == [(1, 5, False), (2, 5, True), (4, 5, None)]
