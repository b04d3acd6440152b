"""Where stored facts come from and whether they may be served: lookups that fail closed, facts bound to their rows, and tasks that are ready."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scopes, mappings that may be served, and the stages of a task in their order.
CONSOLIDATED, PARENT = "CONSOLIDATED", "PARENT_COMPANY"
MAPPED = ["EXACT", "SUPPORTED"]
STAGES = ["PARSING", "QUALITY_CHECK", "BUILDING_FACTS", "BUILDING_TREE", "INDEXING"]

SUBJECT = ["tenant_id", "company", "metric", "fiscal_year"]


def first_broken(rules: dict[str, Column], otherwise: str) -> Column:
    """The name of the first rule that holds; one that cannot be decided does not."""
    return reduce(lambda out, r: F.when(F.coalesce(r[1], F.lit(False)), r[0]).otherwise(out), reversed(rules.items()), F.lit(otherwise))


def structured_lookup(requests: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """request_id, status, reason, route and, where FOUND, fact_id and value: the lookup of stored facts, one row for each request.

    requests: request_id, tenant_id, company, metric (null: no safe mapping), fiscal_year, semantics ('point_in_time' or 'duration') and scope.
    facts: fact_id, document_id, tenant_id, company, metric, fiscal_year, period_type, full_year (of durations), scope, value, mapping_status,
    verification_status, page and source_text. documents: document_id and tenant_id, one row each.

    In this order: a request without metric is UNSUPPORTED_METRIC, one without tenant, company or year UNSUPPORTED_QUERY; facts of its identity that differ
    in value are a CONFLICT; several that fit are AMBIGUOUS; none is NOT_FOUND, with a reason of its own if only the parent company reports; one
    whose document is missing or another tenant's, whose mapping or row is not verified, or whose source is incomplete is not served. Facts are
    counted by identity before the join, so a popular company is one row there.
    """
    kind = F.when(F.col("period_type") == "INSTANT", "INSTANT").otherwise("DURATION")
    fits = (F.col("period_type") == "INSTANT") | F.coalesce("full_year", F.lit(False))
    one = F.when(fits, F.struct("fact_id", "document_id", "value", "mapping_status", "verification_status", "page", "source_text"))
    known = facts.groupBy(*SUBJECT, kind.alias("kind"), "scope").agg(F.count_if(fits).alias("n"), (F.min("value") != F.max("value")).alias("conflict"), F.min(one).alias("fact"))
    parents = known.where(F.col("scope") == PARENT).select(*SUBJECT, "kind", F.col("n").alias("parents"))
    asked = requests.select("request_id", *SUBJECT, F.when(F.col("semantics") == "point_in_time", "INSTANT").otherwise("DURATION").alias("kind"), F.coalesce("scope", F.lit(CONSOLIDATED)).alias("scope"))
    found = asked.join(known, [*SUBJECT, "kind", "scope"], "left").join(parents, [*SUBJECT, "kind"], "left")
    owners = documents.select(F.col("document_id").alias("_document"), F.col("tenant_id").alias("_owner"))
    found = found.join(owners, F.col("fact.document_id") == F.col("_document"), "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    n, fact = F.coalesce("n", F.lit(0)), F.col("fact")
    rules = {
        "query_metric_has_no_safe_registry_mapping": blank("metric"),
        "explicit_tenant_company_or_period_missing": F.coalesce(F.col("tenant_id") <= 0, F.lit(True)) | blank("company") | blank("fiscal_year"),
        "persisted_fact_conflict": F.col("conflict"),
        "multiple_matching_facts_or_document_versions": n > 1,
        "consolidated_scope_missing_parent_only_exists": (n == 0) & (F.col("scope") == CONSOLIDATED) & (F.col("parents") > 0),
        "no_matching_persisted_fact": n == 0,
        "fact_document_tenant_scope_validation_failed": F.coalesce(F.col("_owner") != F.col("tenant_id"), F.lit(True)),
        "stored_fact_failed_company_period_scope_or_metric_validation": ~F.coalesce(fact["mapping_status"].isin(MAPPED) & (fact["verification_status"] == "VERIFIED"), F.lit(False)),
        "citation_provenance_incomplete": fact["page"].isNull() | blank("fact.source_text"),
    }
    names = list(rules)
    reason = F.col("reason")
    status = F.when(reason.isin(names[0], names[7]), "UNSUPPORTED_METRIC").when(reason == names[1], "UNSUPPORTED_QUERY").when(reason == names[2], "CONFLICT").when(reason == names[3], "AMBIGUOUS").when(reason == "", "FOUND").otherwise("NOT_FOUND")
    route = F.when(reason == "", "STRUCTURED_FINANCIAL_FACT").when(reason.isin(names[1], names[5]), "HYBRID_RAG").when(reason == names[3], "STRUCTURED_CLARIFICATION").otherwise("STRUCTURED_SAFE_FAILURE")
    served = lambda c: F.when(reason == "", fact[c]).alias(c)
    return found.withColumn("reason", first_broken(rules, "")).select("request_id", status.alias("status"), F.nullif(reason, F.lit("")).alias("reason"), route.alias("route"), served("fact_id"), served("value"))


def scoped_facts(requests: DataFrame, facts: DataFrame, preferred: str = CONSOLIDATED) -> DataFrame:
    """request_id, scope, reason, fiscal_year, facts and conflicts: what a request for a metric gets, in its own or the preferred scope.

    requests: request_id, company, metric, fiscal_year (null: any), scope (null: the preferred) and latest (the last year that is there).
    conflicts are the years whose facts differ in value. fiscal_year is the year that latest chose.
    """
    if preferred not in (CONSOLIDATED, PARENT):
        raise ValueError("preferred must be one of the two scopes")
    years = facts.groupBy("company", "metric", "scope", "fiscal_year").agg(F.count("*").alias("n"), (F.min("value") != F.max("value")).cast("int").alias("differ"))
    asked = requests.select("request_id", "company", "metric", F.coalesce("scope", F.lit(preferred)).alias("scope"), F.col("fiscal_year").alias("_year"), F.coalesce("latest", F.lit(False)).alias("_latest"), F.when(F.col("scope").isNotNull(), "explicit_scope").otherwise(f"preferred_scope:{preferred}").alias("reason"))
    pair = asked.join(years, ["company", "metric", "scope"], "left").withColumn("_in", F.col("fiscal_year").isNotNull() & (F.col("_year").isNull() | (F.col("_year") == F.col("fiscal_year"))))
    each = F.when(F.col("_in"), F.struct("fiscal_year", "n", "differ"))
    g = pair.groupBy("request_id", "scope", "reason", "_latest").agg(F.max(each).alias("last"), F.sum(F.when(F.col("_in"), F.col("n"))).alias("all"), F.sum(F.when(F.col("_in"), F.col("differ"))).alias("differ"))
    reason = F.concat("reason", F.when(F.col("_latest"), ";latest_from_stored_fiscal_year").otherwise(""))
    of = lambda last, every: F.coalesce(F.when(F.col("_latest"), F.col(last)).otherwise(F.col(every)), F.lit(0)).cast("long")
    return g.select("request_id", "scope", reason.alias("reason"), F.when(F.col("_latest"), F.col("last.fiscal_year")).alias("fiscal_year"), of("last.n", "all").alias("facts"), F.coalesce("differ", F.lit(0)).cast("long").alias("conflicts"))


def digest(names: list[str]) -> Column:
    """SHA-256 over the named columns in order; a null is apart from an empty text and from the word null."""
    shown = [F.coalesce(F.concat(F.lit("="), F.col(n).cast("string")), F.lit("-")) for n in names]
    return F.sha2(F.concat_ws("\u001f", *shown), 256)


def bind_rows(facts: DataFrame, rows: DataFrame, document: str, content: list[str]) -> DataFrame:
    """Each fact with status and row_digest: BOUND to the one verified row of its document that says the same, else NO_ROW or SEVERAL_ROWS;
    document_bound says whether all facts of the document are.

    facts and rows share document and the content columns; rows also have row_id, eligible and any others. Rows that repeat in every column
    count once. The digest is over all columns of the row by name, so a later change of the row shows. Rows are grouped by a digest of what they say.
    """
    short = lambda names: F.unhex(digest(names))
    fact = F.struct(*(F.col(f"`{c}`") for c in facts.columns))
    asked = facts.select(F.col(document).cast("string").alias("_document"), short(content).alias("_key"), fact.alias("_fact"), F.lit(None).cast("binary").alias("_digest"), F.lit(None).cast(rows.schema["row_id"].dataType).alias("_id"))
    proven = rows.where("eligible").select(F.col(document).cast("string").alias("_document"), short(content).alias("_key"), F.lit(None).cast(facts.select(fact.alias("f")).schema["f"].dataType).alias("_fact"), short(sorted(rows.columns)).alias("_digest"), F.col("row_id").alias("_id"))
    # facts and rows of a document move together once; every window below is over its document
    both = asked.unionByName(proven).repartition("_document")
    new = F.col("_digest").isNotNull() & (F.row_number().over(Window.partitionBy("_document", "_key", "_digest").orderBy(F.lit(0))) == 1)
    same = Window.partitionBy("_document", "_key")
    met = both.withColumn("_new", new).withColumns({"_rows": F.count_if("_new").over(same), "_row": F.min(F.when(F.col("_new"), F.struct("_digest", "_id"))).over(same)}).where("_fact IS NOT NULL")
    status = F.when(F.col("_rows") == 1, "BOUND").when(F.col("_rows") > 1, "SEVERAL_ROWS").otherwise("NO_ROW")
    bound = met.withColumn("status", status).withColumn("document_bound", F.min(F.col("status") == "BOUND").over(Window.partitionBy("_document")))
    held = F.col("status") == "BOUND"
    return bound.where("_document IS NOT NULL").select(*(F.col(f"_fact.`{c}`").alias(c) for c in facts.columns), "status", F.when(held, F.col("_row._id")).alias("row_id"), F.when(held, F.lower(F.hex("_row._digest"))).alias("row_digest"), "document_bound")


def promotable(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """task_id and verdict: READY, or the first thing that stands against it.

    tasks: task_id, document_status, task_status and content_sha256. stages: task_id, stage, status, source_sha256, artifact_id, artifact_sha256,
    parse_sha256, quality_sha256 (of what the artifact was made from) and quality_status. Stages that STAGES does not name are ignored; a stage that is
    missing or there twice is incomplete; a task that is already ready stays so if both its states say it.
    """
    of = lambda stage, what: F.max(F.when(F.col("stage") == stage, F.col(what)))
    s = stages.where(F.col("stage").isin(STAGES)).join(tasks.select("task_id", "content_sha256"), "task_id")
    g = s.groupBy("task_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("stage").alias("named"),
        F.count_if(F.col("status") == "complete").alias("complete"),
        F.count_if(~F.col("source_sha256").eqNullSafe(F.col("content_sha256"))).alias("other_source"),
        F.count_if(F.col("artifact_sha256").isNull() | ~F.col("artifact_id").eqNullSafe(F.col("artifact_sha256"))).alias("bad_artifacts"),
        of("PARSING", "artifact_sha256").alias("parsed"),
        of("QUALITY_CHECK", "artifact_sha256").alias("checked"),
        of("QUALITY_CHECK", "quality_status").alias("quality"),
        of("QUALITY_CHECK", "parse_sha256").alias("checked_from"),
        *(of(x, f"{c}_sha256").alias(f"{x}_{c}") for x in ("BUILDING_FACTS", "INDEXING") for c in ("parse", "quality")),
        of("BUILDING_TREE", "quality_sha256").alias("tree_from"),
    )
    t = tasks.select("task_id", "document_status", "task_status").join(g, "task_id", "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    made_from = [differs(f"{x}_{c}", to) for x in ("BUILDING_FACTS", "INDEXING") for c, to in (("parse", "parsed"), ("quality", "checked"))]
    ready, success = F.col("document_status") == "ready", F.col("task_status") == "success"
    rules = {
        "DOCUMENT_IDENTITY_CHANGED": F.col("other_source") > 0,
        "STAGE_INCOMPLETE": F.col("n").isNull() | (F.col("named") < len(STAGES)) | (F.col("n") > len(STAGES)) | (F.col("complete") < len(STAGES)),
        "TERMINAL_FAILURE": F.col("document_status").isin("failed", "quarantined") | (F.col("task_status") == "failed"),
        "ARTIFACT_REFERENCE_INVALID": F.col("bad_artifacts") > 0,
        "QUALITY_GATE_FAILED": ~F.col("quality").eqNullSafe(F.lit("PASS")) | differs("checked_from", "parsed"),
        "ARTIFACT_DEPENDENCY_MISMATCH": reduce(lambda a, b: a | b, made_from),
        "TREE_EVIDENCE_INVALID": differs("tree_from", "checked"),
        "FINAL_STATE_INCONSISTENT": F.coalesce(ready, F.lit(False)) != F.coalesce(success, F.lit(False)),
    }
    return t.select("task_id", first_broken(rules, "READY").alias("verdict"))
