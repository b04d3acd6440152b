"""Trees: integrity of a document's section tree, nested spans of a trace, dependency levels of plans, cover by source blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.operators.corpus import written


def depths(nodes: DataFrame, key: list[str]) -> DataFrame:
    """key, node_id, depth (edges to the root) and rooted (false on cycles, under them, and under parents that are not there).

    Pointer doubling: every round each node takes its ancestor's ancestor, so a tree of depth d takes about log2(d) joins.
    """
    known = nodes.select(*key, F.col("node_id").alias("parent_id"), F.lit(True).alias("there"))
    first = nodes.join(known, [*key, "parent_id"], "left").select(*key, "node_id", F.when(F.col("there"), F.col("parent_id")).alias("jump"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"), (F.col("parent_id").isNull() | F.col("there").isNotNull()).alias("sound"))
    reach, rounds = written(first), 1
    size = reach.groupBy(*key).count().agg(F.max("count").alias("n")).first().n or 1
    while rounds <= size and not reach.where("jump IS NOT NULL").isEmpty():
        up = reach.select(*key, F.col("node_id").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"), F.col("sound").alias("above"))
        reach = written(reach.join(up, [*key, "jump"], "left").select(*key, "node_id", F.col("next").alias("jump"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("sound") & F.coalesce("above", F.lit(True))).alias("sound")))
        rounds *= 2
    rooted = F.col("jump").isNull() & F.col("sound")
    return reach.select(*key, "node_id", F.when(rooted, F.col("depth")).alias("depth"), rooted.alias("rooted"))


def tree_quality(nodes: DataFrame, blocks: DataFrame, key: str = "document_id") -> DataFrame:
    """One row for each document: nodes, max_depth, roots, invalid ranges, parents that are missing or at the wrong level, nodes on or under cycles,
    siblings that share a block, pages and blocks that no section covers, and quality ('INVALID' if anything is wrong, else 'SOUND').

    nodes: document_id, node_id, parent_id, level, start_page, end_page and block_ids. blocks: document_id, block_id and page.
    """
    up = nodes.select(key, F.col("node_id").alias("parent_id"), F.col("level").alias("up_level"), F.col("start_page").alias("up_start"), F.col("end_page").alias("up_end"))
    each = nodes.join(up, [key, "parent_id"], "left")
    outside = (F.col("start_page") > F.col("end_page")) | F.col("up_level").isNotNull() & ((F.col("start_page") < F.col("up_start")) | (F.col("end_page") > F.col("up_end")))
    misplaced = F.col("parent_id").isNotNull() & (F.col("up_level").isNull() | (F.col("level") != F.col("up_level") + 1))
    shape = each.groupBy(key).agg(F.count("*").alias("nodes"), F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count_if(outside).alias("bad_ranges"), F.count_if(misplaced).alias("bad_parents"))
    depth = depths(nodes, [key]).groupBy(key).agg(F.max("depth").alias("max_depth"), F.count_if(~F.col("rooted")).alias("unrooted"))
    held = nodes.select(key, "node_id", "parent_id", "start_page", "end_page", F.explode("block_ids").alias("block_id"))
    # a block held by several children of one parent; counted as pairs without writing the pairs out
    shared = held.where("parent_id IS NOT NULL").groupBy(key, "parent_id", "block_id").agg(F.count_distinct("node_id").alias("n")).groupBy(key).agg(F.sum(F.expr("n * (n - 1) div 2")).alias("shared_blocks"))
    covered = held.join(blocks, [key, "block_id"]).where("page BETWEEN start_page AND end_page").select(key, "block_id").distinct().withColumn("held", F.lit(1))
    # pages that some section spans: the running end of all spans that begin at or before a page
    steps = nodes.where("parent_id IS NOT NULL AND start_page <= end_page").select(key, F.col("start_page").alias("page"), F.col("end_page").alias("until")).unionByName(blocks.select(key, "page", F.lit(None).cast("int").alias("until")))
    w = Window.partitionBy(key).orderBy("page").rangeBetween(Window.unboundedPreceding, 0)
    pages = steps.withColumn("reach", F.max("until").over(w)).where("until IS NULL").groupBy(key, "page").agg(F.max("reach").alias("reach")).groupBy(key).agg(F.count("*").alias("pages"), F.count_if(F.coalesce(F.col("reach"), F.col("page") - 1) < F.col("page")).alias("orphan_pages"))
    loose = blocks.join(covered, [key, "block_id"], "left").groupBy(key).agg(F.count_if(F.col("held").isNull()).alias("loose_blocks"))
    out = shape.join(depth, key).join(shared, key, "left").join(pages, key, "left").join(loose, key, "left").fillna(0, ["shared_blocks", "pages", "orphan_pages", "loose_blocks"])
    wrong = (F.col("roots") != 1) | (F.col("bad_ranges") + F.col("bad_parents") + F.col("unrooted") + F.col("shared_blocks") + F.col("orphan_pages") + F.col("loose_blocks") > 0)
    return out.withColumn("quality", F.when(wrong, "INVALID").otherwise("SOUND"))


def span_tree(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, parent_id, depth, duration and self_time of every span of every trace.

    spans: trace_id, span_id, start and end (whole numbers). In order of start (the longer first, then by id) a span's parent is the last one
    before it that has not ended when it ends. Self time is a span's duration without its children's, not below 0.
    """
    one = F.struct("start", (-F.col("end")).alias("less"), "span_id")
    kind = dict(spans.dtypes)
    frame = f"struct<span_id:{kind['span_id']},end:bigint>"
    out = f"array<struct<span_id:{kind['span_id']},parent_id:{kind['span_id']},depth:int,duration:bigint>>"
    start = F.struct(F.array().cast(f"array<{frame}>").alias("stack"), F.array().cast(out).alias("out"))

    def step(state: Column, s: Column) -> Column:
        end = -s["less"]
        stack = F.filter(state["stack"], lambda x: x["end"] >= end)
        row = F.struct(s["span_id"].alias("span_id"), F.try_element_at(stack, F.lit(-1))["span_id"].alias("parent_id"), F.size(stack).alias("depth"), (end - s["start"]).alias("duration"))
        return F.struct(F.concat(stack, F.array(F.struct(s["span_id"].alias("span_id"), end.alias("end")))).alias("stack"), F.concat(state["out"], F.array(row)).alias("out"))

    traces = spans.select("trace_id", "span_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).groupBy("trace_id").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    each = traces.select("trace_id", F.explode(F.aggregate("spans", start, step, lambda s: s["out"])).alias("s")).select("trace_id", "s.*")
    children = each.where("parent_id IS NOT NULL").groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.sum("duration").alias("inner"))
    return each.join(children, ["trace_id", "span_id"], "left").select("trace_id", "span_id", "parent_id", "depth", "duration", F.greatest(F.col("duration") - F.coalesce("inner", F.lit(0)), F.lit(0)).alias("self_time"))


def plan_steps(questions: DataFrame) -> DataFrame:
    """plan_id, step (from 1), kind, company and depends_on of the plan of every question.

    questions: plan_id, intent ('comparison', 'single_company', 'global_research' or 'generic') and companies. A comparison retrieves for each company, compares
    what they gave and sums up; the others retrieve once, then reason (one company) or sum up (global research).
    """
    n = F.size(F.coalesce("companies", F.array().cast("array<string>")))
    step = lambda at, kind, company, needs: F.struct(F.lit(at).cast("int").alias("step") if isinstance(at, int) else at.cast("int").alias("step"), F.lit(kind).alias("kind"), company.cast("string").alias("company"), needs.cast("array<int>").alias("depends_on"))
    none, nobody = F.array(), F.lit(None)
    fetched = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    retrieve = F.transform("companies", lambda c, i: step(i + 1, "retrieve", c, none))
    compare = F.concat(retrieve, F.array(step(n + 1, "compare", nobody, fetched), step(n + 2, "synthesis", nobody, F.array(n + 1))))
    single = F.array(step(1, "retrieve", F.try_element_at("companies", F.lit(1)), none), step(2, "reasoning", nobody, F.array(F.lit(1))))
    whole = F.array(step(1, "retrieve", nobody, none), step(2, "synthesis", nobody, F.array(F.lit(1))))
    plan = F.when(F.col("intent") == "comparison", compare).when(F.col("intent") == "single_company", single).when(F.col("intent") == "global_research", whole).otherwise(F.array(step(1, "retrieve", nobody, none)))
    return questions.select("plan_id", F.explode(plan).alias("s")).select("plan_id", "s.*")


def dependency_levels(steps: DataFrame) -> DataFrame:
    """plan_id, step and level: 0 for steps that need nothing, else one more than the highest they need; null for steps on a cycle, behind one,
    or behind a step that is not there. One join for each level of the deepest plan."""
    needs = steps.select("plan_id", "step", F.explode("depends_on").alias("needed")).distinct()
    left = written(steps.select("plan_id", "step", F.size(F.array_distinct("depends_on")).alias("missing")))
    done, level = None, 0
    frontier = left.where("missing = 0").select("plan_id", "step", F.lit(0).alias("level"))
    while not frontier.isEmpty():
        done = frontier if done is None else done.unionByName(frontier)
        met = needs.join(frontier.select("plan_id", F.col("step").alias("needed")), ["plan_id", "needed"], "left_semi").groupBy("plan_id", "step").agg(F.count("*").alias("met"))
        left = written(left.where("missing > 0").join(met, ["plan_id", "step"], "left").select("plan_id", "step", (F.col("missing") - F.coalesce("met", F.lit(0))).alias("missing")))
        level += 1
        frontier = left.where("missing = 0").select("plan_id", "step", F.lit(level).alias("level"))
    found = done if done is not None else frontier
    return steps.select("plan_id", "step").join(found, ["plan_id", "step"], "left")


def cover(candidates: DataFrame, k: int) -> DataFrame:
    """Up to k source blocks of each request by greedy cover: query_id, place, block_id, new (aspects it adds).

    candidates: query_id, block_id, aspects (a bit for each required aspect that it supports), score, page and reading_order. Each step takes the
    block with most aspects not yet covered, then most aspects, best score, first page, first in reading order, least id. Blocks without aspects are
    taken only for requests where no block has any. A request has as many candidates as its ranking kept.
    """
    some = F.max("aspects").over(Window.partitionBy("query_id"))
    pool = candidates.withColumn("_some", some).where("aspects <> 0 OR _some = 0")
    one = F.struct((-F.bit_count("aspects")).alias("all"), (-F.col("score")).alias("score"), "page", "reading_order", "block_id", "aspects")
    kind = candidates.select(one.alias("s")).schema["s"].dataType.simpleString()
    chosen = f"array<struct<block_id:{dict(candidates.dtypes)['block_id']},new:int>>"
    start = F.struct(F.col("pool").cast(f"array<{kind}>").alias("rest"), F.lit(0).cast("long").alias("covered"), F.array().cast(chosen).alias("out"))

    def step(state: Column, _: Column) -> Column:
        fresh = lambda x: F.bit_count(x["aspects"].bitwiseAND(F.bitwise_not(state["covered"])))
        best = F.array_min(F.transform(state["rest"], lambda x: F.struct((-fresh(x)).alias("fresh"), x.alias("x"))))
        took = F.struct(F.filter(state["rest"], lambda x: x["block_id"] != best["x"]["block_id"]).alias("rest"), state["covered"].bitwiseOR(best["x"]["aspects"]).alias("covered"), F.concat(state["out"], F.array(F.struct(best["x"]["block_id"].alias("block_id"), (-best["fresh"]).cast("int").alias("new")))).alias("out"))
        return F.when(F.size(state["rest"]) > 0, took).otherwise(state)

    pools = pool.groupBy("query_id").agg(F.collect_list(one).alias("pool"))
    out = pools.select("query_id", F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda s: s["out"]).alias("out"))
    return out.select("query_id", F.posexplode("out").alias("place", "s")).select("query_id", (F.col("place") + 1).alias("place"), "s.block_id", "s.new")
