"""What is worked out, moved or sorted once."""

from pyspark.sql import functions as F

from evidara.functions import grounding as G
from evidara.operators import corpus, ledger, provenance


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_ledger_reads_each_piece_by_itself(spark):
    rows = [
        (1, "C1", "FY2020", "In Q2 2019 sales came to $5 million. net income reached $7 million. For FY2018 it rained; sales were $3 million.", None),
        (2, "C1", "FY2020", "net income was $8 million.", '[{"metric":"sales","period":"FY2020","value":"4","currency":"USD"}]'),
        (3, "C1", "FY2020", "sales were $9 million.", '[{"metric":"sales","period":null,"value":"4","currency":"USD"},{"metric":"sales","period":"FY1","value":"n/a","currency":"USD"}]'),
    ]
    evidence = spark.createDataFrame(rows, "evidence_id long, company string, period string, text string, rows_json string")
    facts = ledger.from_evidence(evidence, {"sales": "sales", "net income": "net_income"})
    assert "Window" not in plan(facts) and "Join" not in plan(facts)
    got = sorted((r.evidence_id, r.metric, r.period, int(r.value), r.path) for r in facts.collect())
    assert got == [(1, "net_income", "Q2_2019", 7_000_000, "text"), (1, "sales", "FY2018", 3_000_000, "text"), (1, "sales", "Q2_2019", 5_000_000, "text"), (2, "sales", "FY2020", 4, "typed"), (3, "sales", "FY2020", 9_000_000, "text")]
    settled = ledger.settled(facts)
    assert "Expand" not in plan(settled)
    assert {(r.metric, r.period): (r.status, r.mentions, r.value and int(r.value)) for r in settled.collect()}[("sales", "FY2020")] == ("OK", 2, 4)


def test_facts_and_rows_move_once(spark):
    facts = spark.createDataFrame([(1, "a", 5, "x"), (1, "b", 5, "x"), (2, "c", 6, None), (2, "d", 7, "y"), (3, "e", 1, "z")], "doc long, fact_id string, value int, label string")
    rows = spark.createDataFrame([(1, "r1", 5, "x", True), (1, "r1", 5, "x", True), (2, "r2", 6, None, True), (2, "r3", 7, "y", True), (2, "r4", 7, "y", True), (3, "r5", 1, "z", False)], "doc long, row_id string, value long, label string, eligible boolean")
    bound = provenance.bind_rows(facts, rows, "doc", ["value", "label"])
    assert plan(bound).count("Exchange hashpartitioning") == 1
    got = {r.fact_id: (r.status, r.row_id, r.document_bound, r.row_digest is not None) for r in bound.collect()}
    assert got == {"a": ("BOUND", "r1", True, True), "b": ("BOUND", "r1", True, True), "c": ("BOUND", "r2", False, True), "d": ("SEVERAL_ROWS", None, False, False), "e": ("NO_ROW", None, False, False)}


def test_numbers_of_evidence_are_read_once(spark):
    s = spark.createDataFrame([("up 50.0%", "$3 million against $2 million")], "line string, evidence string").repartition(1)
    for claim in (G.disposition(F.col("line"), G.numbers("evidence")), G.supports_derived(G.numbers("line"), G.numbers("evidence"), F.col("line"))):
        assert plan(s.select(claim.alias("x")), "optimizedPlan").count("regexp_extract_all(") == 2
    assert s.select(G.disposition(F.col("line"), G.numbers("evidence"))).first()[0] == "DERIVABLE"


def test_written_rows_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def mark(x):
        seen.add(1)
        return x

    kept = corpus.written(spark.range(10).select(F.udf(mark, "long")("id").alias("id")))
    assert sorted(r.id for r in kept.collect()) == list(range(10)) and not kept.isEmpty() and seen.value == 10
