"""Rules over facts, table rows, plans and candidates, as column expressions and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import periods as P
from evidara.functions.text import listed


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def period_conflict(content: Column, row_period: Column, quarter: Column, expected: Column) -> Column:
    """Whether evidence names another period than the expected one. Periods in the text weigh most, then those of the row; none is no
    conflict, and the document's own quarter excuses another spelling of it."""
    said, rows = P.quarters(content), listed(F.coalesce(row_period, F.lit("")))
    same = P.normal_period(expected)
    excused = (P.normal_period(quarter) == same) & F.exists(said, lambda p: P.normal_period(p) == same)
    by_text = ~(F.array_contains(said, expected) | F.coalesce(excused, F.lit(False)))
    return F.when(F.size(said) > 0, by_text).when(F.size(rows) > 0, ~F.array_contains(rows, expected)).otherwise(False)


def assess_row(fields: list[str], value: Column, source_text: Column, bound: Column, detected: Column) -> Column:
    """VERIFIED, PARTIAL or UNVERIFIED with the reasons: a row without a value, its text, its place in the source or a proven column
    is not verified; one that lacks a field is partly so."""
    missing = [F.when(blank(F.col(f)), F.lit(f"missing_{f}")) for f in fields]
    reasons = F.array_compact(F.array(*missing, F.when(~bound, F.lit("row_column_binding_not_proven")), F.when(~detected, F.lit("source_row_not_detected"))))
    status = F.when(~detected | value.isNull() | blank(source_text) | ~bound, "UNVERIFIED").when(F.size(reasons) > 0, "PARTIAL").otherwise("VERIFIED")
    return F.struct(status.alias("status"), reasons.alias("reasons"))


#: Words that ask for the statements of the parent company, and of the group.
PARENT_WORDS = r"母公司|母公司口径|单体报表|母公司报表|parent\s+company|standalone"
GROUP_WORDS = r"合并口径|合并报表|consolidated"


def report_scope(question: Column) -> Column:
    """The statements that a question is about, and whether it says so."""
    q = F.lower(question)
    parent, group = q.rlike(PARENT_WORDS), q.rlike(GROUP_WORDS)
    scope = F.when(parent, "PARENT_COMPANY").otherwise("CONSOLIDATED")
    reason = F.when(parent, "explicit_parent_company").when(group, "explicit_consolidated").otherwise("default_consolidated")
    return F.struct(scope.alias("scope"), reason.alias("reason"))


def years_of(text: Column) -> Column:
    """Years from 2000 on that stand alone, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![0-9])(20[0-9]{2})(?![0-9])"), F.lit(1)))


#: A report is named by its year.
#: Fixed value: the report of a year.
REPORT = r"(?i)(?<!\d)(20\d{2})\s*年?(?:年度报告|年报)|\b(?:FY\s*)?(20\d{2})\s+annual\s+report\b"


def period_bound(question: Column, report_period: Column, fiscal_year: Column) -> Column:
    """Whether a narrative is bound to each kind of year that a question names: that of the report and that of the observation."""
    reports = F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(REPORT), F.lit(0)), lambda m: F.regexp_extract(m, "(20[0-9]{2})", 1)))
    observed = years_of(F.regexp_replace(question, REPORT, " "))
    own = F.nullif(F.regexp_extract(F.coalesce(report_period, F.lit("")), "^FY(20[0-9]{2})$", 1), F.lit(""))
    report_ok = (F.size(reports) == 0) | F.coalesce(F.array_contains(reports, own), F.lit(False))
    return report_ok & ((F.size(observed) == 0) | F.coalesce(F.array_contains(observed, fiscal_year), F.lit(False)))


def squeezed(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", "")


def company_matches(asked: Column, company_id: Column, name: Column) -> Column:
    """The same id, or names of which one (of three letters at least) holds the other."""
    q, n = squeezed(asked), squeezed(name)
    held = (F.length(q) >= 3) & (n != "") & (F.contains(n, q) | F.contains(q, n))
    return F.coalesce(asked == company_id, F.lit(False)) | held


def lookup_company(asked: DataFrame, companies: DataFrame) -> DataFrame:
    """query_id, title and score of the best company of each query: by its ticker, its title, the title's begin, within the title or within the
    ticker. Two titles with one best score are ambiguous and give none. asked: query_id, name (few); companies: title, ticker."""
    q, t, k = squeezed(F.col("name")), squeezed(F.col("title")), squeezed(F.col("ticker"))
    score = F.when(q == k, 100).when(q == t, 90).when(F.startswith(t, q), 80).when(F.contains(t, q), 70).when(F.contains(k, q), 60)
    hits = companies.join(asked, (q != "") & score.isNotNull()).select("query_id", "title", score.alias("score"))
    best = hits.groupBy("query_id").agg(F.max("score").alias("score"))
    titles = hits.join(best, ["query_id", "score"]).groupBy("query_id", "score").agg(F.min("title").alias("title"), F.count_distinct("title").alias("n"))
    return titles.where("n = 1").select("query_id", "title", "score")


def aspect_coverage(required: Column, covered: Column, known: Column) -> Column:
    """Which required aspects are covered, and the grade; an aspect nobody knows makes it UNKNOWN."""
    there, missing = F.array_intersect(required, covered), F.array_except(required, covered)
    grade = F.when((F.size(required) == 0) | (F.size(F.array_except(required, known)) > 0), "UNKNOWN").when(F.size(missing) == 0, "SATISFIED").when(F.size(there) > 0, "PARTIAL").otherwise("INSUFFICIENT")
    return F.struct(there.alias("covered"), missing.alias("missing"), grade.alias("grade"))


#: States from best to worst, and the counters that must not grow.
STATES = ["READY", "QUARANTINED", "FAILED"]
COUNTERS = ["critical_orphans", "unexplained_dropped_blocks", "recovery_provenance_loss"]


def compare_policies(old: DataFrame, new: DataFrame) -> DataFrame:
    """document_id, what got worse under a new policy, and whether the document may be promoted. Both: document_id, state and the counters."""
    place = lambda s: F.array_position(F.array(*map(F.lit, STATES)), s)
    o, n = old.alias("o"), new.alias("n")
    worse = [F.when(place(F.col("n.state")) > place(F.col("o.state")), F.lit("quality_status"))] + [F.when(F.col(f"n.{c}") > F.col(f"o.{c}"), F.lit(c.upper())) for c in COUNTERS]
    regressions = F.array_compact(F.array(*worse))
    joined = o.join(n, F.col("o.document_id") == F.col("n.document_id"))
    return joined.select("o.document_id", regressions.alias("regressions"), ((F.size(regressions) == 0) & (F.col("n.state") == "READY")).alias("promote"))


def same_owner(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts whose document is there and belongs to the same tenant. Both: document_id, tenant_id."""
    return facts.join(documents.select("document_id", F.col("tenant_id").alias("_owner")), "document_id").where(F.col("tenant_id") == F.col("_owner")).drop("_owner")


def required_first(items: DataFrame, required: DataFrame, key: str, order: str) -> DataFrame:
    """Each query's items with their place: those of required chunks first, both parts in their old order."""
    marked = items.join(required.select(key, "chunk_id").distinct().withColumn("_req", F.lit(0)), [key, "chunk_id"], "left")
    w = Window.partitionBy(key).orderBy(F.coalesce("_req", F.lit(1)), order)
    return marked.withColumn("place", F.row_number().over(w)).withColumn("required", F.col("_req").isNotNull()).drop("_req")


def within_budget(costs: Column, budget: int) -> Column:
    """Which of the costs fit, taken in order: one that is too dear for what is left is passed over."""

    def take(acc: Column, c: Column) -> Column:
        fits = c <= acc["left"]
        return F.struct(F.when(fits, acc["left"] - c).otherwise(acc["left"]).alias("left"), F.concat(acc["out"], F.array(fits)).alias("out"))

    return F.aggregate(costs, F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<boolean>").alias("out")), take, lambda a: a["out"])


def dependencies_met(needs: Column, done: Column) -> Column:
    """Whether all steps that a step needs are done."""
    return F.forall(F.coalesce(needs, F.array().cast("array<int>")), lambda d: F.array_contains(done, d))


def reserve_slots(scored: Column, required: Column, k: int) -> Column:
    """Keys of k rows: for each required dimension in order the first row that has it and is not taken, then the others in order.

    scored: an array of structs of key and dimensions, the best first; a query's candidates, a few hundred at most.
    """
    none = F.array().cast("array<bigint>")

    def take(taken: Column, dimension: Column) -> Column:
        fit = F.filter(scored, lambda r: F.array_contains(r["dimensions"], dimension) & ~F.array_contains(taken, r["key"]))
        return F.when(F.size(fit) > 0, F.concat(taken, F.array(F.get(fit, 0)["key"]))).otherwise(taken)

    slots = F.aggregate(required, none, take)
    return F.slice(F.array_union(slots, F.transform(scored, lambda r: r["key"])), 1, k)


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def overlap_share(a: Column, b: Column) -> Column:
    """The part of a that b covers."""
    both = F.struct(F.greatest(a["x0"], b["x0"]).alias("x0"), F.greatest(a["y0"], b["y0"]).alias("y0"), F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"))
    return area(both) / F.greatest(area(a), F.lit(1e-9))


def union_area(boxes: Column) -> Column:
    """The exact area that rectangles cover: slabs between neighbouring x, in each the merged intervals of y."""
    real = F.filter(boxes, lambda b: area(b) > 0)
    xs = F.array_sort(F.array_distinct(F.flatten(F.transform(real, lambda b: F.array(b["x0"], b["x1"])))))

    def covered(left: Column, right: Column) -> Column:
        spans = F.array_sort(F.transform(F.filter(real, lambda b: (b["x0"] < right) & (b["x1"] > left)), lambda b: F.struct(b["y0"].alias("lo"), b["y1"].alias("hi"))))
        add = lambda acc, s: F.struct((acc["sum"] + F.greatest(F.lit(0.0), s["hi"] - F.greatest(s["lo"], acc["end"]))).alias("sum"), F.greatest(acc["end"], s["hi"]).alias("end"))
        return F.aggregate(spans, F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("end")), add, lambda a: a["sum"])

    slabs = F.zip_with(F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), lambda l, r: (r - l) * covered(l, r))
    return F.aggregate(slabs, F.lit(0.0), lambda s, x: s + x)


def ledger_lookup(facts: DataFrame, period: str | None = None, **wanted: object) -> DataFrame:
    """Facts that meet every constraint given, by either of their periods; those of statements come first."""
    found = reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in wanted.items() if v is not None), facts)
    if period is not None:
        want = P.normal_period(F.lit(period))
        found = found.where((P.normal_period("fact_period") == want) | (P.normal_period("table_column_period") == want))
    return found.withColumn("weaker", F.when(F.col("source_kind") == "FINANCIAL_STATEMENT", 0).otherwise(1))


def rows_from_json(text: Column, schema: str) -> Column:
    """Typed rows of a JSON array; what is no array of rows gives none."""
    return F.coalesce(F.filter(F.from_json(text, f"array<{schema}>"), lambda r: r.isNotNull()), F.array().cast(f"array<{schema}>"))
