"""Stored facts, answers, follow-ups, headings and small chunks against plain readings, with ties, gaps and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from evidara.functions import blocks as B
from evidara.operators import chunking, citations, provenance


def test_headings_and_cells(spark):
    headings = ["4.2 Risk factors", "section iv) what follows", "Liquidity and:", "OUTLOOK", "SUMMARY OF RESULTS", "Net Sales By Region", "Net Sales\nBy Region", "管理层讨论", "IV. The rest"]
    others = [None, "", " \n ", "Net sales rose.", "Net sales rose", "RISKS 2024", "Outlook", "ABC", "One\nTwo\nThree Four", "Q3 FY2024", "March 31,", "12,345", "讨论", "A " * 17 + "B", "X" * 141]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(headings + others)], "i int, t string")
    got = {r.i: (r.h, r.c) for r in rows.select("i", B.heading("t").alias("h"), B.table_cell("t").alias("c")).collect()}
    assert [i for i, (h, _) in sorted(got.items()) if h] == list(range(len(headings)))
    assert {(headings + others)[i] for i, (_, c) in got.items() if c} == {"4.2 Risk factors", "RISKS 2024", "Q3 FY2024", "March 31,", "12,345"}


def plain_merge(chunks, least):
    """A list that is changed in place, chunk by chunk."""
    norm = lambda t: " ".join(t.split()).lower()
    cross = lambda a, b: {a[1], b[1]} == {"table", "unverified_table"}
    bare = lambda c: norm(c[0]) == norm(c[2])

    def join(a, b):
        seen, out = set(), []
        for p in (a[0] + "\n\n" + b[0]).split("\n\n"):
            if norm(p) and norm(p) not in seen:
                seen.add(norm(p))
                out.append(p.strip())
        kind = "unverified_table" if "unverified_table" in (a[1], b[1]) else a[1] if a[1] == b[1] else "mixed"
        return ("\n\n".join(out), kind, b[2] if bare(a) and not bare(b) else a[2])

    left, i = list(chunks), 0
    while len(left) > 1 and i < len(left):
        at = i if i + 1 < len(left) else i - 1
        if len(norm(left[i][0])) >= least and not bare(left[i]) or cross(left[at], left[at + 1]):
            i += 1
        else:
            left[at : at + 2] = [join(left[at], left[at + 1])]
            i = max(at, 0)
    return left


def test_small_chunks_join_as_a_list_would(spark):
    rnd, pages = random.Random(5), {}
    for page in range(300):
        pages[page] = [(rnd.choice(["a", "Head", "b\n\na", "x" * 9, "y y  y y y", "", "q" * 14]), rnd.choice(["text", "table", "unverified_table", "mixed"]), rnd.choice(["Head", "head ", "S"])) for _ in range(rnd.randint(1, 9))]
    rows = spark.createDataFrame([(1, p, i, *c) for p, cs in pages.items() for i, c in enumerate(cs)], "doc_id long, page long, place int, text string, kind string, section string")
    got = {}
    for r in chunking.merge_small_chunks(rows, 8).orderBy("page", "chunk").collect():
        got.setdefault(r.page, []).append((r.text, r.kind, r.section))
    assert got == {p: plain_merge(cs, 8) for p, cs in pages.items()}
    odd = spark.createDataFrame([(1, 1, 0, None, "text", None), (1, 1, 1, "b", None, "S")], rows.schema)
    assert [(r.text, r.section) for r in chunking.merge_small_chunks(odd, 8).collect()] == [("b", "S")]
    assert not chunking.merge_small_chunks(rows.limit(0)).collect()


def test_answers_keep_what_supports_them(spark):
    evidence = [(1, 1, "up from $100 million"), (1, 2, "it was $120 million"), (2, 1, "$150 million after $120 million"), (2, 2, "$1 million after $2 million"), (3, 2, "nothing"), (3, 3, None), (4, 1, "x"), (5, 1, "$150 million after $0")]
    answers = [(1, "Sales were $120.0 million"), (2, "growth of 25%"), (3, "Sales were $9 million"), (4, None), (5, "an increase of 25%"), (6, "$5 million")]
    got = citations.supported_evidence(spark.createDataFrame(evidence, "question_id int, place int, content string"), spark.createDataFrame(answers, "question_id int, answer string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, "supported"), (2, 1, "supported"), (3, 2, "unverified"), (4, 1, None), (5, 1, "unverified")]


def test_scores_of_words(spark):
    rows = [("Gross-Margin rose", ["gross margin", "eps"], None), ("a b c", None, "a A d"), ("", None, None), (" x", [], ""), (None, ["x"], "y"), ("a", None, "收入")]
    df = spark.createDataFrame(rows, "r string, t array<string>, f string")
    got = [tuple(r) for r in df.select(citations.lexical_quality("r", "t", "f"), citations.claim_coverage("r", "t")).collect()]
    assert got == [(50.0, 0.0), (50.0, 100.0), (0.0, 100.0), (100.0, 100.0), (0.0, 0.0), (100.0, 100.0)]


def test_follow_ups_stop_at_another_topic(spark):
    turns = [
        (1, 0, "user", "acme sales"), (1, 1, "assistant", "bolt"), (1, 2, "user", "and it?"), (1, 3, "user", " "), (1, 4, "user", "it again"), (1, 5, "user", "weather"), (1, 6, "user", "it"),
        (2, 0, "user", "it"), (2, 1, "USER", "it and acme"), (2, 2, "user", "it and bolt"), (2, None, "user", "it"), (2, 2, "user", "a"), (None, 3, "user", "it"), (3, 4, "user", None),
        (4, 0, "user", "bolt"), (4, 9_000, "user", "it"), (4, 30_000, "user", "it"),
    ]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    names = F.filter(F.array(F.lit("acme"), F.lit("bolt")), lambda n: F.contains(F.col("text"), n))
    got = sorted((r.conv_id, r.turn, r.prior_turn, r.entities) for r in citations.prior_requests(df, F.contains(F.col("text"), F.lit("it")), names).collect())
    assert got == [(1, 2, 0, ["acme"]), (1, 4, 0, ["acme"]), (2, 2, 1, ["acme"]), (4, 9_000, 0, ["bolt"]), (4, 30_000, 0, ["bolt"])]


FACT = "fact_id string, document_id int, tenant_id int, company string, metric string, fiscal_year int, period_type string, full_year boolean, scope string, value int, mapping_status string, verification_status string, page int, source_text string"


def test_lookups_fail_closed(spark):
    def fact(i, company, **other):
        base = dict(fact_id=i, document_id=1, tenant_id=1, company=company, metric="m", fiscal_year=2020, period_type="INSTANT", full_year=None, scope="CONSOLIDATED", value=7, mapping_status="EXACT", verification_status="VERIFIED", page=3, source_text="7")
        return tuple((base | other).values())

    facts = [fact("a", "one"), fact("b", "two"), fact("c", "two"), fact("d", "odds"), fact("e", "odds", value=8), fact("f", "parent", scope="PARENT_COMPANY"), fact("g", "foreign", document_id=2), fact("h", "lost", document_id=9), fact("i", "loose", verification_status=None), fact("j", "bare", source_text=" "), fact("k", "part", period_type="DURATION", full_year=False)]
    known = spark.createDataFrame(facts, FACT)
    documents = spark.createDataFrame([(1, 1), (2, 2)], "document_id int, tenant_id int")
    asked = ["one", "two", "odds", "parent", "foreign", "lost", "loose", "bare", "part", "nobody"]
    rows = [(c, 1, c, "m", 2020, "duration" if c == "part" else "point_in_time", None) for c in asked] + [("no metric", 0, "one", None, 2020, "point_in_time", None), ("no year", 1, "one", "m", None, "point_in_time", None), ("no tenant", None, "one", "m", 2020, "point_in_time", None)]
    requests = spark.createDataFrame(rows, "request_id string, tenant_id int, company string, metric string, fiscal_year int, semantics string, scope string")
    got = {r.request_id: (r.status, r.route.rsplit("_", 1)[1], r.value) for r in provenance.structured_lookup(requests, known, documents).collect()}
    assert got == {
        "one": ("FOUND", "FACT", 7), "two": ("AMBIGUOUS", "CLARIFICATION", None), "odds": ("CONFLICT", "FAILURE", None), "parent": ("NOT_FOUND", "FAILURE", None), "foreign": ("NOT_FOUND", "FAILURE", None), "lost": ("NOT_FOUND", "FAILURE", None),
        "loose": ("UNSUPPORTED_METRIC", "FAILURE", None), "bare": ("NOT_FOUND", "FAILURE", None), "part": ("NOT_FOUND", "RAG", None), "nobody": ("NOT_FOUND", "RAG", None),
        "no metric": ("UNSUPPORTED_METRIC", "FAILURE", None), "no year": ("UNSUPPORTED_QUERY", "RAG", None), "no tenant": ("UNSUPPORTED_QUERY", "RAG", None),
    }
    empty = provenance.structured_lookup(requests, known.limit(0), documents.limit(0))
    assert {r.status for r in empty.collect()} == {"NOT_FOUND", "UNSUPPORTED_METRIC", "UNSUPPORTED_QUERY"}
    with pytest.raises(ValueError):
        provenance.scoped_facts(requests, known, "ANY")


def test_facts_bind_to_one_verified_row(spark):
    rows = [(1, "x", 5, "r1", True), (1, "x", 5, "r1", True), (1, "y", 6, "r2", True), (1, "y", 6, "r3", True), (2, "x", None, "r4", True), (2, "z", 1, "r5", False)]
    df = spark.createDataFrame(rows, "doc int, label string, value int, row_id string, eligible boolean")
    facts = spark.createDataFrame([("f1", 1, "x", 5), ("f2", 1, "y", 6), ("f3", 2, "x", None), ("f4", 3, "x", 5), ("f5", 2, "x", None)], "fact_id string, doc int, label string, value int")
    got = {r.fact_id: (r.status, r.row_id, r.document_bound, r.row_digest is not None) for r in provenance.bind_rows(facts, df, "doc", ["label", "value"]).collect()}
    assert got == {"f1": ("BOUND", "r1", False, True), "f2": ("SEVERAL_ROWS", None, False, False), "f3": ("BOUND", "r4", True, True), "f4": ("NO_ROW", None, False, False), "f5": ("BOUND", "r4", True, True)}


def test_tasks_are_ready_only_when_all_agrees(spark):
    def stages(task, drop=(), **change):
        out = []
        for s in provenance.STAGES:
            row = dict(task_id=task, stage=s, status="complete", source_sha256="c", artifact_id=s, artifact_sha256=s, parse_sha256="PARSING", quality_sha256="QUALITY_CHECK", quality_status="PASS")
            row |= change.get(s, {})
            out += [tuple(row.values())] * (s not in drop)
        return out

    rows = [*stages(1), *stages(2, drop=["INDEXING"]), *stages(3, INDEXING={"parse_sha256": None}), *stages(4, PARSING={"source_sha256": None}), *stages(5), *stages(5, drop=provenance.STAGES[1:]), *stages(6, QUALITY_CHECK={"quality_status": None}), *stages(7), *stages(8), *stages(9, BUILDING_TREE={"artifact_id": None}), (1, "EXTRA", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "task_id int, stage string, status string, source_sha256 string, artifact_id string, artifact_sha256 string, parse_sha256 string, quality_sha256 string, quality_status string")
    state = {7: ("ready", "running"), 8: ("ready", "success")}
    tasks = spark.createDataFrame([(i, *state.get(i, ("processing", "running")), "c") for i in range(1, 11)], "task_id int, document_status string, task_status string, content_sha256 string")
    got = {r.task_id: r.verdict for r in provenance.promotable(tasks, df).collect()}
    assert got == {1: "READY", 2: "STAGE_INCOMPLETE", 3: "ARTIFACT_DEPENDENCY_MISMATCH", 4: "DOCUMENT_IDENTITY_CHANGED", 5: "STAGE_INCOMPLETE", 6: "QUALITY_GATE_FAILED", 7: "FINAL_STATE_INCONSISTENT", 8: "READY", 9: "ARTIFACT_REFERENCE_INVALID", 10: "STAGE_INCOMPLETE"}
