"""Ledgers, layouts, trees and retrieval against plain readings, with ties, gaps and odd rows."""

import random

from pyspark.sql import functions as F

from evidara.operators import evaluation, layout, ledger, retrieval, trees


def test_numbers_bind_within_their_sentence(spark):
    rows = [
        (1, "C", "FY2020", "In Q3 2021 net sales rose 5% to $12 million. Net income was ($3) million.", None),
        (2, "C", "FY2020", "Nothing here costs $7 million.", None),
        (3, "C", "FY2020", "net sales of $9 million", '[{"metric":"revenue","period":"FY2020","value":"9.5","currency":"USD"},{"metric":"x","period":null,"value":"1"}]'),
        (4, "C", None, None, None),
        (5, "C", "FY2020", "Sales and net sales were $1 million" + " " * 90 + "and $2 million", "not json"),
    ]
    evidence = spark.createDataFrame(rows, "evidence_id long, company string, period string, text string, rows_json string")
    got = sorted((r.evidence_id, r.metric, r.period, float(r.value), r.kind, r.path) for r in ledger.from_evidence(evidence, {"sales": "other", "net sales": "revenue", "net income": "net_income"}).collect())
    assert got == [
        (1, "net_income", "Q3_2021", -3e6, "amount", "text"), (1, "revenue", "Q3_2021", 5.0, "percent", "text"), (1, "revenue", "Q3_2021", 12e6, "amount", "text"),
        (3, "revenue", "FY2020", 9.5, "amount", "typed"), (5, "revenue", "FY2020", 1e6, "amount", "text"),
    ]


def test_preferred_ties(spark):
    rows = [("a", "f1", 100, "fiscal_quarter", 0.5), ("a", "f2", 100, "fiscal_quarter", 0.5), ("a", "f3", 300, "six_months", 0.9), ("b", "g1", 7, None, 0.1), ("c", "h1", 10, None, 0.5), ("c", "h2", 11, None, 0.5), ("c", "h3", 11, None, 0.4)]
    facts = spark.createDataFrame(rows, "k string, fact_id string, value long, period_type string, confidence double")
    pick = lambda wants: {r.k: (r.fact_id, r.score) for r in ledger.preferred(facts, ["k"], F.lit(wants).cast("string")).collect()}
    assert pick("quarter") == {"a": ("f2", 44), "b": ("g1", 0), "c": ("h2", 18)}
    assert pick("cumulative")["a"] == ("f3", 40)


def test_statements_end_at_gaps_and_headings(spark):
    rows = [("d", 1, 1.0, "statement", "s1", 0), ("d", 1, 1.0, "table", "t1", 2), ("d", 2, 0.5, "table", "t2", 3), ("d", 4, 0.5, "table", "t3", 9), ("d", 4, 0.7, "table", "t4", 9), ("d", 5, 0.1, "statement", "s2", 0), ("d", 5, 0.2, "section", "x", 0), ("d", 6, 0.1, "table", "t5", 1), ("d", 6, 0.2, "section", "y", 0), ("d", 6, 0.3, "table", "t6", 9), ("d", 7, 0.1, "statement", "s3", 0), ("d", 7, 0.2, "stop", "z", 0), ("d", 7, 0.3, "table", "t7", 9)]
    events = spark.createDataFrame(rows, "document string, page long, y double, kind string, event_id string, rows long")
    assert sorted(tuple(r) for r in layout.statements(events).collect()) == [("d", "s1", 1, 2, 2, 5), ("d", "s2", 5, 6, 1, 1)]


def test_carried_over_range_borders(spark):
    r = random.Random(3)
    rows = [(g, i, r.choice([None] * 8 + ["h", "reset"])) for g in "ab" for i in range(200)]
    expected, state = [], None
    for g, i, e in rows:
        state = None if i == 0 else state
        state = {None: state, "reset": None}.get(e, f"{e}{i}" if e else state)
        expected.append((g, i, state))
    df = spark.createDataFrame(rows, "g string, i long, e string")
    value = F.when(F.col("e") == "h", F.concat("e", F.col("i").cast("string")))
    for span in (7, 1000):
        got = layout.carry_forward(df, ["g"], "i", value, F.col("e") == "reset", "state", span).select("g", "i", "state")
        assert sorted(tuple(x) for x in got.collect()) == sorted(expected)


def test_line_anchors_do_not_grow(spark):
    spans = [(1, "a", 0, 0, 10), (1, "b", 5, 3, 13), (1, "c", 9, 6, 16), (1, "d", 2, 5, 5), (1, "e", 1, 4, 14)]
    got = {r.span_id: r.line for r in layout.lines(spark.createDataFrame(spans, "page int, span_id string, x long, y long, bottom long"), ["page"]).collect()}
    assert got == {"a": 1, "b": 1, "e": 2, "c": 2, "d": 3}


def test_depths_of_deep_trees_and_cycles(spark):
    chain = [("x", i, i - 1 if i else None) for i in range(300)]
    odd = [("x", 400, 401), ("x", 401, 400), ("x", 402, 401), ("x", 500, -1), ("x", 501, 500), ("y", 0, None), ("y", 1, 1)]
    got = {(r.t, r.node_id): (r.depth, r.rooted) for r in trees.depths(spark.createDataFrame(chain + odd, "t string, node_id long, parent_id long"), ["t"]).collect()}
    assert all(got["x", i] == (i, True) for i in range(300)) and got["y", 0] == (0, True)
    assert all(got["x", i] == (None, False) for i in (400, 401, 402, 500, 501)) and got["y", 1] == (None, False)


def test_spans_nest_by_containment(spark):
    spans = [("t", 1, 0, 100), ("t", 2, 10, 40), ("t", 3, 20, 30), ("t", 4, 35, 60), ("t", 5, 36, 39), ("t", 6, 100, 100), ("t", 7, 0, 100)]
    got = {r.span_id: (r.parent_id, r.depth, r.self_time) for r in trees.span_tree(spark.createDataFrame(spans, "trace_id string, span_id long, start long, end long")).collect()}
    assert got == {1: (None, 0, 0), 7: (1, 1, 45), 2: (7, 2, 20), 3: (2, 3, 10), 4: (7, 2, 22), 5: (4, 3, 3), 6: (7, 2, 0)}


def test_dependency_levels_report_cycles(spark):
    steps = [(1, 1, []), (1, 2, [1, 1]), (1, 3, [1, 2]), (2, 1, [2]), (2, 2, [1]), (2, 3, [2]), (2, 4, [9]), (3, 1, [])]
    got = {(r.plan_id, r.step): r.level for r in trees.dependency_levels(spark.createDataFrame(steps, "plan_id int, step int, depends_on array<int>")).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 1): None, (2, 2): None, (2, 3): None, (2, 4): None, (3, 1): 0}


def test_cover_is_greedy(spark):
    r = random.Random(5)
    rows = [(q, b, r.choice([0, 1, 2, 3, 5, 8, 12]) if q else 0, r.choice([0.1, 0.2]), r.randint(0, 1), r.randint(0, 1)) for q in range(6) for b in range(7)]
    got = {}
    for x in trees.cover(spark.createDataFrame(rows, "query_id int, block_id int, aspects long, score double, page int, reading_order int"), 4).orderBy("query_id", "place").collect():
        got.setdefault(x.query_id, []).append((x.block_id, x.new))
    for q in range(6):
        mine, covered, out = [x for x in rows if x[0] == q], 0, []
        mine = [x for x in mine if x[2]] if any(x[2] for x in mine) else mine
        while mine and len(out) < 4:
            best = min(mine, key=lambda x: (-(x[2] & ~covered).bit_count(), -x[2].bit_count(), -x[3], x[4], x[5], x[1]))
            out.append((best[1], (best[2] & ~covered).bit_count()))
            covered |= best[2]
            mine.remove(best)
        assert got[q] == out


def test_vectors_of_several_widths_and_ties(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, None)], "query_id long, query_vector array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in retrieval.vector_top(vectors, queries, 2).collect())
    assert got == [(1, 1, 1, 1.0), (1, 2, 2, 1.0), (2, 1, 4, 0.0)]


def test_judging_by_label_equals_judging_by_pairs(spark):
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 13), (2, 2, 13)], "query_id long, rank int, doc_id long")
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, label string")
    items = spark.createDataFrame([(10, "a"), (11, "b"), (12, "a"), (13, "b"), (14, None)], "doc_id long, label string")
    pairs = queries.join(items, "label", "left").select("query_id", "doc_id")
    plain = evaluation.ranked_metrics(ranked, pairs, 2).orderBy("query_id").collect()
    assert evaluation.metrics_of_hits(*evaluation.by_label(ranked, queries, items), 2).orderBy("query_id").collect() == plain
