"""Column functions, limits and streams on small inputs."""

import pytest
from pyspark.sql import functions as F

from evidara.functions import numbers as N
from evidara.functions import periods as P
from evidara.functions import text as T
from evidara.operators import corpus, facts, retrieval
from evidara.streaming import limits, windows


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("Net Profit_2024 净利润 利润 和"))) == ["net", "profit", "2024", "净利润", "净利", "利润", "利润", "和"]
    assert one(spark, T.clean(F.lit(" re-\n venue  grew\n\nfast "))) == "revenue grew fast"


def test_windows_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    for size, overlap in [(100, 0), (100, 30), (999, 1), (1000, 10), (3000, 5)]:
        parts = one(spark, T.windows(F.lit(text), size, overlap))
        assert parts[0] + "".join(p[overlap:] for p in parts[1:]) == text and all(len(p) == size for p in parts[:-1])
    assert one(spark, T.windows(F.lit(""), 10, 0)) == [""]
    with pytest.raises(ValueError):
        T.windows(F.lit("x"), 5, 5)


def test_periods(spark):
    assert one(spark, P.quarters(F.lit("Q1 FY27 and q4-2024, 2025 Q1; Q4-2024"))) == ["Q1_FY2027", "Q4_2024", "Q1_2025"]
    assert one(spark, P.quarters(F.lit("Q4-2024 Q1-2025"))) == ["Q4_2024", "Q1_2025"]
    assert [one(spark, P.prior_period(F.lit(p))) for p in ("FY2024", "Q3_2020", "Q1_FY2025", "2024")] == ["FY2023", "Q3_2019", "Q1_FY2024", None]
    assert one(spark, P.normal_period(F.lit("q1-fy2024"))) == "Q1_2024"
    assert one(spark, P.explicit_year(F.lit("in 2023 and 2023"))) == 2023 and one(spark, P.explicit_year(F.lit("2022 to 2023"))) is None


def test_numbers(spark):
    assert [str(one(spark, N.source_number(F.lit(s))).normalize()) for s in ("1,234.50", "(2,000)")] == ["1234.5", "-2E+3"]
    assert one(spark, N.source_number(F.lit("n/a"))) is None
    assert one(spark, N.growth(F.lit(-50), F.lit(-100))) == 50 * -1 and one(spark, N.growth_rate(F.lit(-50), F.lit(-100))) == 50
    assert one(spark, N.growth(F.lit(1), F.lit(0))) is None
    assert one(spark, N.presented(F.lit(1_234_567_890))) == "1.23 billion"
    assert one(spark, N.fact_id(F.lit("a"), F.lit(None))) != one(spark, N.fact_id(F.lit("a")))


def test_presented_rounds_the_hundredths(spark):
    assert [one(spark, N.presented(F.lit(v))) for v in (-1_015_000_000, 1_255_000_000, 1_005_000)] == ["-1.01 billion", "1.25 billion", "1.00 million"]
    assert [one(spark, N.presented(F.lit(v))) for v in (1_125_000_000, -1_125_000, 0.375, 5)] == ["1.13 billion", "-1.13 million", "0.38", "5.00"]


def test_cards_behind_other_numbers(spark):
    texts = {"at 38.253.197.126 4880761348116108.": ["card"], "1 2 4815819516090933": ["card"], "38.253.197.126 4880761348116109": [], "48807613481161081 4880761": []}
    assert {t: one(spark, T.sensitive_classes(F.lit(t))) for t in texts} == texts


def test_scope_and_lookup(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "t long")
    seen = lambda public: sorted(str(r.t) for r in df.where(retrieval.in_scope(F.col("t"), F.lit(1), public)).collect())
    assert seen(False) == ["1", "None"] and seen(True) == ["0", "1", "None"]
    resolved = facts.resolve_conflicts(spark.createDataFrame([("a", "m", 1, 5), ("a", "m", 1, 6), ("b", "m", 1, 5), ("b", "m", 2, 7)], "company string, metric string, fiscal_year int, value int"), ["company", "metric", "fiscal_year"])
    asked = spark.createDataFrame([(1, "a", "m", 1), (2, "b", "m", 1), (3, "b", "m", None), (4, "c", "m", 1)], "request_id int, company string, metric string, fiscal_year int")
    assert {r.request_id: (r.status, r.value) for r in facts.lookup(asked, resolved).collect()} == {1: ("CONFLICT", None), 2: ("FOUND", 5), 3: ("AMBIGUOUS", None), 4: ("NOT_FOUND", None)}


def test_fusion_prefers_both_channels(spark):
    rows = [(1, "x", "vector", 1, 1.0), (1, "y", "vector", 2, 1.0), (1, "y", "lexical", 1, 1.0), (1, "z", "lexical", 2, 1.0)]
    got = retrieval.fuse(spark.createDataFrame(rows, "query_id int, key string, channel string, rank int, weight double"), 3).orderBy("rank").collect()
    assert [r.key for r in got] == ["y", "x", "z"] and got[0].score == 1.0 and got[1].lexical_rank == 3


def events(spark, times, user=1):
    return spark.createDataFrame([(i, user, t) for i, t in enumerate(times)], "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))


def test_limits(spark):
    allowed = lambda df: [r.allowed for r in df.orderBy("event_id").collect()]
    e = events(spark, [0, 1, 2, 9, 10, 11, 30])
    assert allowed(limits.sliding_log(e, 2, 10)) == [True, True, False, False, True, True, True]
    assert allowed(limits.fixed_window(e, 2, 10)) == [True, True, False, False, False, True, True]
    f = events(spark, [0, 1, 2, 20, 21]).withColumn("failed", F.col("event_id").isin(0, 1, 3))
    assert [r.state for r in limits.circuit_breaker(f, 2, 10).orderBy("event_id").collect()] == ["CLOSED", "OPEN", "OPEN", "OPEN", "OPEN"]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    table = events(spark, [0, 50, 3600, 90_000, 200_000]).withColumn("event_type", F.lit("a")).withColumn("value", F.lit(1.0))
    table.unionByName(table.where("event_id = 1")).write.parquet(str(tmp_path / "events.parquet"))
    s = windows.stream(spark, str(tmp_path), "events")

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert run(windows.once(s), "once").count() == 5
    batch = {(str(r.start), r.events) for r in windows.tumbling(spark.read.parquet(str(tmp_path / "events.parquet"))).collect()}
    streamed = {(str(r.start), r.events) for r in run(windows.tumbling(s), "daily").collect()}
    # the last day stays open until a later event passes the watermark
    assert streamed and streamed < batch


def test_trees_and_audits(spark):
    nodes = spark.createDataFrame([(2, 1), (3, 1), (4, 3), (1, 4)], "node_id long, parent_id long")
    got = corpus.descend(nodes, spark.createDataFrame([(1,)], "node_id long")).collect()
    assert sorted((r.node_id, r.depth, r.path) for r in got) == [(1, 0, "1"), (2, 1, "1/2"), (3, 1, "1/3"), (4, 2, "1/3/4")]
    bad = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0, 1.0])], "vec_id long, embedding array<float>")
    assert corpus.vector_audit(bad).first().asDict() == {"vectors": 3, "sizes": 2, "not_finite": 1, "zero": 1, "repeated_ids": 1}
