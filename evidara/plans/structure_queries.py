"""Ledgers out of evidence, statements and lines out of positions, trees, plans and covers. Inputs are views of the given tables; the SQL
reads the same tables and works the answer out in its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import layout, ledger, trees
from evidara.plans.registry import query
from evidara.sources import tables as S

#: Aliases of metrics in the rendered evidence.
ALIASES = {"net sales": "revenue", "total revenue": "revenue", "sales": "revenue", "operating cash flow": "operating_cash_flow", "gross margin": "gross_margin", "net income": "net_income"}


def evidence(spark, sf):
    """Each order as a piece of evidence: sentences with figures, and typed rows for every fourth."""
    price = F.format_string("%.2f", F.col("o_totalprice"))
    year = F.year("o_orderdate").cast("string")
    alias = F.element_at(F.array(F.lit("Net sales"), F.lit("total revenue"), F.lit("sales")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    flow = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("In Q2 "), F.year("o_orderdate") - 1, F.lit(", operating cash flow"))).otherwise(F.lit("Operating cash flow"))
    text = F.concat(F.lit("For FY"), year, F.lit(" "), alias, F.lit(" came to $"), price, F.lit(" million. "), flow, F.lit(" reached USD "), F.col("o_custkey") + 10, F.lit(" thousand, see page 12.\nThe gross margin was "), F.col("o_custkey") % 40 + 10, F.lit("% while net income fell to ($"), F.col("o_orderkey") + 10, F.lit(") million; in 2019 it rained 12 days."))
    row = F.struct(F.lit("revenue").alias("metric"), F.concat(F.lit("FY"), year).alias("period"), price.alias("value"), F.lit("USD").alias("currency"))
    bad = F.struct(F.lit("net_income").alias("metric"), F.lit(None).cast("string").alias("period"), F.lit("n/a").alias("value"), F.lit("USD").alias("currency"))
    typed = F.when(F.col("o_orderkey") % 4 == 0, F.to_json(F.array(row, bad))).when(F.col("o_orderkey") % 4 == 1, F.to_json(F.array(bad)))
    return S.read(spark, sf, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.concat(F.lit("C"), (F.col("o_custkey") % 25).cast("string")).alias("company"), F.concat(F.lit("FY"), year).alias("period"), text.alias("text"), typed.alias("rows_json"))


FACTS = """o AS (SELECT o_orderkey AS evidence_id, 'C' || (o_custkey % 25) AS company, year(o_orderdate) AS y, CAST(o_totalprice AS DECIMAL(15,2)) AS price, o_custkey AS c, o_orderkey AS k FROM orders),
facts AS (SELECT evidence_id, company, 'revenue' AS metric, 'FY' || y AS period, CAST(price AS DECIMAL(38,6)) AS value, 'amount' AS kind, 'usd' AS currency, 'typed' AS path FROM o WHERE k % 4 = 0
UNION ALL SELECT evidence_id, company, 'revenue', 'FY' || y, CAST(price AS DECIMAL(38,6)) * 1000000, 'amount', 'usd', 'text' FROM o WHERE k % 4 <> 0
UNION ALL SELECT evidence_id, company, 'operating_cash_flow', CASE WHEN k % 5 = 0 THEN 'Q2_' || (y - 1) ELSE 'FY' || y END, CAST((c + 10) * 1000 AS DECIMAL(38,6)), 'amount', 'usd', 'text' FROM o WHERE k % 4 <> 0
UNION ALL SELECT evidence_id, company, 'gross_margin', CASE WHEN k % 5 = 0 THEN 'Q2_' || (y - 1) ELSE 'FY' || y END, CAST(c % 40 + 10 AS DECIMAL(38,6)), 'percent', NULL, 'text' FROM o WHERE k % 4 <> 0
UNION ALL SELECT evidence_id, company, 'net_income', CASE WHEN k % 5 = 0 THEN 'Q2_' || (y - 1) ELSE 'FY' || y END, CAST(-(k + 10) * 1000000 AS DECIMAL(38,6)), 'amount', 'usd', 'text' FROM o WHERE k % 4 <> 0)"""


@query(f"WITH {FACTS} SELECT evidence_id, company, metric, period, CAST(value AS DOUBLE) AS value, kind, currency, path FROM facts")
def q9_ledger(spark, sf):
    return ledger.from_evidence(evidence(spark, sf), ALIASES).withColumn("value", F.col("value").cast("double"))


@query(f"WITH {FACTS}, g AS (SELECT company, metric, period, kind, count(*) AS mentions, count(*) FILTER (path = 'typed') AS t, list_distinct(list(value) FILTER (path = 'typed')) AS tv, list_distinct(list(value) FILTER (path = 'text')) AS xv FROM facts GROUP BY ALL), v AS (SELECT *, CASE WHEN t > 0 THEN tv ELSE xv END AS vs FROM g) SELECT company, metric, period, kind, mentions, CASE WHEN len(vs) > 1 THEN 'CONFLICT' ELSE 'OK' END AS status, CASE WHEN len(vs) = 1 THEN CAST(vs[1] AS DOUBLE) END AS value FROM v")
def a17_ledger_conflicts(spark, sf):
    return ledger.settled(ledger.from_evidence(evidence(spark, sf), ALIASES)).withColumn("value", F.col("value").cast("double"))


ITEM = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"


def item_id():
    return F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")), F.col("l_quantity").cast("long").cast("string"))


@query(f"""WITH f AS (SELECT l_suppkey, l_returnflag, {ITEM} AS fact_id, CAST(l_quantity AS BIGINT) * 100 AS value, CASE l_linenumber % 4 WHEN 0 THEN 'fiscal_quarter' WHEN 1 THEN 'six_months' WHEN 2 THEN 'fiscal_year' ELSE NULL END AS period_type, l_discount AS confidence, CASE l_suppkey % 3 WHEN 0 THEN 'cumulative' WHEN 1 THEN 'quarter' END AS wants FROM lineitem WHERE l_quantity > 20 OR l_suppkey % 2 = 0),
s AS (SELECT l_suppkey, l_returnflag, list_sort(list(value)) AS vs FROM f GROUP BY 1, 2),
r AS (SELECT l_suppkey, l_returnflag, value, count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT f.*, CASE WHEN len(vs) < 2 THEN 0 ELSE CASE WHEN vs[1] > 0 AND vs[-1] >= 1.5 * vs[1] THEN CASE WHEN value = CASE WHEN wants = 'cumulative' THEN vs[-1] ELSE vs[1] END THEN 12 ELSE -12 END WHEN abs(value - vs[len(vs) // 2 + 1]) <= 0.05 * greatest(vs[-1] - vs[1], 1) THEN 10 ELSE -10 END + least(4 * r.n, 20) END + CASE WHEN wants IS NULL OR period_type IS NULL OR period_type = 'fiscal_year' THEN 0 WHEN (wants = 'cumulative') = (period_type = 'six_months') THEN 24 ELSE -24 END AS score FROM f JOIN s USING (l_suppkey, l_returnflag) JOIN r USING (l_suppkey, l_returnflag, value))
SELECT DISTINCT ON (l_suppkey, l_returnflag) l_suppkey, l_returnflag, fact_id, value, period_type, CAST(score AS BIGINT) AS score FROM p ORDER BY l_suppkey, l_returnflag, score DESC, floor(confidence * 1000) DESC, value DESC, fact_id DESC""")
def y2_preferred(spark, sf):
    n = F.col("l_linenumber") % 4
    kind = F.when(n == 0, "fiscal_quarter").when(n == 1, "six_months").when(n == 2, "fiscal_year")
    wants = F.when(F.col("l_suppkey") % 3 == 0, "cumulative").when(F.col("l_suppkey") % 3 == 1, "quarter")
    facts = S.read(spark, sf, "lineitem").where("l_quantity > 20 OR l_suppkey % 2 = 0").select("l_suppkey", "l_returnflag", item_id().alias("fact_id"), (F.col("l_quantity").cast("long") * 100).alias("value"), kind.alias("period_type"), F.col("l_discount").alias("confidence"), wants.alias("wants"))
    return ledger.preferred(facts, ["l_suppkey", "l_returnflag"], "wants")


EVENTS = f"SELECT l_suppkey AS document, year(l_shipdate) * 12 + month(l_shipdate) AS page, l_extendedprice AS y, CASE l_partkey % 8 WHEN 0 THEN 'statement' WHEN 1 THEN 'section' WHEN 2 THEN CASE WHEN l_linenumber > 4 THEN 'stop' ELSE 'table' END ELSE 'table' END AS kind, {ITEM} AS event_id, CAST(l_quantity AS BIGINT) AS rows FROM lineitem"


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY page, y, CASE WHEN kind = 'table' THEN 1 ELSE 0 END, event_id) AS n FROM ({EVENTS} WHERE l_linenumber > 0)),
f AS (SELECT document, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS statement, CAST(NULL AS BIGINT) AS start_page, CAST(NULL AS BIGINT) AS last_page, CAST(0 AS BIGINT) AS took, CAST(0 AS BIGINT) AS page FROM (SELECT DISTINCT document FROM e)
UNION ALL SELECT e.document, e.n, CASE WHEN kind = 'statement' THEN event_id WHEN kind = 'stop' OR kind = 'section' AND last_page IS NOT NULL OR kind = 'table' AND e.page - last_page > 1 THEN NULL ELSE statement END, CASE WHEN kind = 'statement' THEN e.page ELSE start_page END, CASE WHEN kind IN ('statement', 'stop') OR kind = 'section' AND last_page IS NOT NULL OR kind = 'table' AND e.page - last_page > 1 THEN NULL WHEN kind = 'table' AND statement IS NOT NULL THEN e.page ELSE last_page END, CASE WHEN kind = 'table' AND statement IS NOT NULL AND (last_page IS NULL OR e.page - last_page <= 1) THEN rows ELSE 0 END, e.page FROM f JOIN e ON e.document = f.document AND e.n = f.n + 1)
SELECT document, statement, start_page, max(page) AS end_page, count(*) AS tables, CAST(sum(took) AS BIGINT) AS rows FROM f WHERE took > 0 GROUP BY document, statement, start_page""")
def g5_statements(spark, sf):
    k = F.col("l_partkey") % 8
    kind = F.when(k == 0, "statement").when(k == 1, "section").when((k == 2) & (F.col("l_linenumber") > 4), "stop").otherwise("table")
    events = S.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("document"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("page"), F.col("l_extendedprice").alias("y"), kind.alias("kind"), item_id().alias("event_id"), F.col("l_quantity").cast("long").alias("rows"))
    return layout.statements(events)


LINE = r"SELECT doc_id, line, t FROM (SELECT doc_id, unnest(ls) AS t, unnest(range(0, len(ls))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))"
COUNT_WORDS = r"len(regexp_extract_all(t, '[^ \t\n\r]+'))"


def text_lines(spark, sf):
    return S.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumns({"line": F.col("line").cast("long"), "n": F.regexp_count("t", F.lit(r"[^ \t\n\r]+"))})


@query(f"WITH l AS (SELECT doc_id, line, t, {COUNT_WORDS} AS n FROM ({LINE})), e AS (SELECT *, CASE WHEN n BETWEEN 1 AND 8 THEN trim(t) WHEN n > 60 THEN '-' END AS ev FROM l) SELECT doc_id, line, nullif(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING), '-') AS context FROM e")
def z10_table_context(spark, sf):
    """Short lines are headers of what follows, until prose of over 60 words."""
    l = text_lines(spark, sf)
    return layout.carry_forward(l, ["doc_id"], "line", F.when(F.col("n").between(1, 8), F.trim("t")), F.col("n") > 60, "context", span=100).select("doc_id", "line", "context")


@query(rf"WITH l AS (SELECT doc_id, line, line // 10 AS page, t, {COUNT_WORDS} AS n FROM ({LINE})), e AS (SELECT *, CASE WHEN n > 0 AND n <= 20 AND regexp_matches(lower(t), 'th') THEN trim(t) WHEN regexp_matches(t, '^[IVXA-H]+[a-z]*\.') THEN '' END AS ev FROM l) SELECT doc_id, line, nullif(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY line ROWS UNBOUNDED PRECEDING), '') AS context FROM e")
def y5_page_context(spark, sf):
    """As z10_table_context, but no further than the page; sections end it."""
    l = text_lines(spark, sf).withColumn("page", F.floor(F.col("line") / 10))
    value = F.when(F.col("n").between(1, 20) & F.lower("t").rlike("th"), F.trim("t"))
    return layout.carry_forward(l, ["doc_id", "page"], "line", value, F.col("t").rlike(r"^[IVXA-H]+[a-z]*\."), "context").select("doc_id", "line", "context")


@query(f"""WITH RECURSIVE s AS (SELECT l_orderkey AS page, {ITEM} AS span_id, l_partkey AS x, CAST(l_quantity AS BIGINT) AS y, CAST(l_quantity AS BIGINT) + l_linenumber * 3 AS bottom FROM (SELECT DISTINCT * FROM lineitem)),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, span_id) AS n FROM s),
f AS (SELECT page, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(y BIGINT, b BIGINT)[]) AS anchors, CAST(0 AS BIGINT) AS line, CAST(NULL AS VARCHAR) AS span_id, CAST(NULL AS BIGINT) AS x, CAST(NULL AS BIGINT) AS y FROM (SELECT DISTINCT page FROM o)
UNION ALL SELECT page, n, CASE WHEN hit = 0 THEN list_append(anchors, {{'y': y, 'b': bottom}}) ELSE anchors END, CASE WHEN hit = 0 THEN len(anchors) + 1 ELSE hit END, span_id, x, y FROM (SELECT o.page, o.n, o.span_id, o.x, o.y, o.bottom, f.anchors, coalesce(list_position(list_transform(f.anchors, lambda a: least(a.b, o.bottom) - greatest(a.y, o.y) >= 0.7 * least(a.b - a.y, o.bottom - o.y)), true), 0) AS hit FROM f JOIN o ON o.page = f.page AND o.n = f.n + 1))
SELECT page, span_id, CAST(line AS INTEGER) AS line, CAST(row_number() OVER (PARTITION BY page ORDER BY line, x, y, span_id) AS INTEGER) AS place FROM f WHERE n > 0""")
def x32_lines(spark, sf):
    y = F.col("l_quantity").cast("long")
    spans = S.read(spark, sf, "lineitem").distinct().select(F.col("l_orderkey").alias("page"), item_id().alias("span_id"), F.col("l_partkey").alias("x"), y.alias("y"), (y + F.col("l_linenumber") * 3).alias("bottom"))
    return layout.lines(spans, ["page"])


#: Orders of 50 customers' groups as nodes of trees, each node under the one at a third of its place; some parents are missing, some nodes their own.
NODES = """SELECT d AS document_id, k AS node_id, CASE WHEN r = 0 THEN NULL WHEN k % 97 = 0 THEN -1 WHEN k % 101 = 0 THEN k ELSE up END AS parent_id, CASE WHEN r = 0 THEN 0 WHEN r < 3 THEN 1 WHEN r < 9 THEN 2 WHEN r < 27 THEN 3 WHEN r < 81 THEN 4 WHEN r < 243 THEN 5 WHEN r < 729 THEN 6 WHEN r < 2187 THEN 7 ELSE 8 END AS level, CASE WHEN r = 0 THEN 0 ELSE CAST(r % 40 AS INTEGER) END AS start_page, CASE WHEN r = 0 THEN 60 ELSE CAST(r % 40 + k % 7 - 1 AS INTEGER) END AS end_page, r FROM (SELECT a.d, a.k, a.r, b.k AS up FROM p a LEFT JOIN p b ON a.d = b.d AND b.r = floor(a.r / 3))"""
PLACES = "p AS (SELECT o_custkey % 50 AS d, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS r FROM orders)"


@query(f"""WITH RECURSIVE {PLACES}, n AS MATERIALIZED ({NODES}), b AS (SELECT d AS document_id, unnest(range(0, 100)) AS block_id FROM (SELECT DISTINCT d FROM p)), blocks AS MATERIALIZED (SELECT document_id, block_id, block_id % 50 AS page FROM b),
t AS (SELECT document_id, node_id, 0 AS depth FROM n WHERE parent_id IS NULL UNION ALL SELECT n.document_id, n.node_id, t.depth + 1 FROM t JOIN n ON n.document_id = t.document_id AND n.parent_id = t.node_id),
h AS MATERIALIZED (SELECT document_id, node_id, parent_id, start_page, end_page, unnest(list_distinct([r % 100, (r * 7) % 100])) AS block_id FROM n),
c AS (SELECT n.*, u.level AS ul, u.start_page AS us, u.end_page AS ue FROM n LEFT JOIN n u ON u.document_id = n.document_id AND u.node_id = n.parent_id),
s AS (SELECT document_id, count(*) AS nodes, count(*) FILTER (parent_id IS NULL) AS roots, count(*) FILTER (start_page > end_page OR ul IS NOT NULL AND (start_page < us OR end_page > ue)) AS bad_ranges, count(*) FILTER (parent_id IS NOT NULL AND (ul IS NULL OR level <> ul + 1)) AS bad_parents FROM c GROUP BY 1),
d AS (SELECT document_id, max(depth) AS max_depth, count(*) AS rooted FROM t GROUP BY 1),
o AS (SELECT x.document_id, count(*) AS shared_blocks FROM h x JOIN h y ON x.document_id = y.document_id AND x.parent_id = y.parent_id AND x.block_id = y.block_id AND x.node_id < y.node_id GROUP BY 1),
g AS (SELECT document_id, count(*) AS pages, count(*) FILTER (NOT EXISTS (SELECT 1 FROM n WHERE n.document_id = q.document_id AND parent_id IS NOT NULL AND q.page BETWEEN start_page AND end_page)) AS orphan_pages FROM (SELECT DISTINCT document_id, page FROM blocks) q GROUP BY 1),
l AS (SELECT document_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM h WHERE h.document_id = k.document_id AND h.block_id = k.block_id AND k.page BETWEEN start_page AND end_page)) AS loose_blocks FROM blocks k GROUP BY 1)
SELECT *, CASE WHEN roots <> 1 OR bad_ranges + bad_parents + unrooted + shared_blocks + orphan_pages + loose_blocks > 0 THEN 'INVALID' ELSE 'SOUND' END AS quality FROM (SELECT s.document_id, nodes, roots, bad_ranges, bad_parents, CAST(max_depth AS BIGINT) AS max_depth, nodes - rooted AS unrooted, coalesce(shared_blocks, 0) AS shared_blocks, pages, orphan_pages, loose_blocks FROM s JOIN d USING (document_id) LEFT JOIN o USING (document_id) JOIN g USING (document_id) JOIN l USING (document_id))""")
def a26_tree_quality(spark, sf):
    S.read(spark, sf, "orders").createOrReplaceTempView("orders_of_trees")
    nodes = spark.sql(f"WITH {PLACES.replace('FROM orders', 'FROM orders_of_trees')} {NODES}")
    nodes = nodes.withColumn("block_ids", F.array_distinct(F.array(F.col("r") % 100, F.col("r") * 7 % 100)))
    blocks = nodes.select("document_id").distinct().select("document_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))).alias("block_id")).withColumn("page", (F.col("block_id") % 50).cast("int"))
    return trees.tree_quality(nodes, blocks)


SPANS = "SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS trace_id, event_id AS span_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 100) AS BIGINT) * 36000000 AS e FROM events"


@query(f"WITH RECURSIVE t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY s, e DESC, span_id) AS n FROM ({SPANS})), q AS MATERIALIZED (SELECT a.trace_id, a.span_id, max_by(b.span_id, b.n) AS parent_id FROM t a LEFT JOIN t b ON a.trace_id = b.trace_id AND b.n < a.n AND b.e >= a.e GROUP BY 1, 2), p AS (SELECT trace_id, span_id, parent_id, 0 AS depth FROM q WHERE parent_id IS NULL UNION ALL SELECT q.trace_id, q.span_id, q.parent_id, p.depth + 1 FROM p JOIN q ON q.trace_id = p.trace_id AND q.parent_id = p.span_id), c AS (SELECT trace_id, parent_id AS span_id, sum(e - s) AS inner_time FROM p JOIN t USING (trace_id, span_id) WHERE parent_id IS NOT NULL GROUP BY 1, 2) SELECT trace_id, span_id, parent_id, CAST(depth AS INTEGER) AS depth, e - s AS duration, CAST(greatest(e - s - coalesce(inner_time, 0), 0) AS BIGINT) AS self_time FROM p JOIN t USING (trace_id, span_id) LEFT JOIN c USING (trace_id, span_id)")
def z34_span_tree(spark, sf):
    """Events of a user and day as spans, their value in hours."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = S.read(spark, sf, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"), F.col("event_id").alias("span_id"), start.alias("start"), (start + F.floor(F.col("value") * 100) * 36_000_000).alias("end"))
    return trees.span_tree(spans)


@query("""WITH u AS (SELECT user_id AS plan_id, CASE user_id % 4 WHEN 0 THEN 'comparison' WHEN 1 THEN 'single_company' WHEN 2 THEN 'global_research' ELSE 'generic' END AS intent, list_sort(list_distinct(list(event_type))) AS c FROM events GROUP BY 1)
SELECT plan_id, CAST(i AS INTEGER) AS step, 'retrieve' AS kind, c[i] AS company, 0 AS level FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM u WHERE intent = 'comparison')
UNION ALL SELECT plan_id, CAST(len(c) + 1 AS INTEGER), 'compare', NULL, 1 FROM u WHERE intent = 'comparison' UNION ALL SELECT plan_id, CAST(len(c) + 2 AS INTEGER), 'synthesis', NULL, 2 FROM u WHERE intent = 'comparison'
UNION ALL SELECT plan_id, 1, 'retrieve', CASE WHEN intent = 'single_company' THEN c[1] END, 0 FROM u WHERE intent <> 'comparison' UNION ALL SELECT plan_id, 2, CASE WHEN intent = 'single_company' THEN 'reasoning' ELSE 'synthesis' END, NULL, 1 FROM u WHERE intent IN ('single_company', 'global_research')""")
def q1_plans(spark, sf):
    """A plan for each user, its companies the types of the user's events."""
    u = F.col("user_id") % 4
    intent = F.when(u == 0, "comparison").when(u == 1, "single_company").when(u == 2, "global_research").otherwise("generic")
    asked = S.read(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("companies")).select(F.col("user_id").alias("plan_id"), intent.alias("intent"), "companies")
    steps = trees.plan_steps(asked)
    return steps.join(trees.dependency_levels(steps), ["plan_id", "step"]).select("plan_id", "step", "kind", "company", "level")


ASPECTS = ["that", "with", "this", "from", "ment", "tion"]


@query(f"""WITH RECURSIVE b AS (SELECT conv_id AS query_id, turn, turn // 2 AS page, length(coalesce(text, '')) % 5 / 4.0 AS score, {" + ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{w}') THEN {1 << i} ELSE 0 END" for i, w in enumerate(ASPECTS))} AS aspects FROM conversations),
c AS (SELECT * FROM (SELECT *, max(aspects) OVER (PARTITION BY query_id) AS m FROM b) WHERE aspects <> 0 OR m = 0),
g AS (SELECT query_id, list({{'turn': turn, 'page': page, 'score': score, 'aspects': aspects}}) AS rest, 0 AS covered, 0 AS place, CAST(NULL AS BIGINT) AS block_id, 0 AS new FROM c GROUP BY 1
UNION ALL SELECT query_id, list_filter(rest, lambda x: x.turn <> best.x.turn), covered | best.x.aspects, place + 1, best.x.turn, -best.fresh FROM (SELECT query_id, rest, covered, place, list_sort(list_transform(rest, lambda x: {{'fresh': -bit_count(x.aspects & ~g.covered), 'all': -bit_count(x.aspects), 'score': -x.score, 'page': x.page, 'turn': x.turn, 'x': x}}))[1] AS best FROM g WHERE place < 3 AND len(rest) > 0))
SELECT query_id, place, block_id, CAST(new AS INTEGER) AS new FROM g WHERE place > 0""")
def r15_cover(spark, sf):
    """Up to three turns of each conversation that hold most aspects."""
    t = F.coalesce("text", F.lit(""))
    aspects = sum((F.when(F.contains(F.lower(t), F.lit(w)), 1 << i).otherwise(0) for i, w in enumerate(ASPECTS)), F.lit(0)).cast("long")
    blocks = S.messages(spark, sf).select(F.col("conv_id").alias("query_id"), F.col("turn").alias("block_id"), aspects.alias("aspects"), (F.length(t) % 5 / 4).alias("score"), F.floor(F.col("turn") / 2).alias("page"), F.col("turn").alias("reading_order"))
    return trees.cover(blocks, 3)
