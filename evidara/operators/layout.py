"""What position on a page says: statements carried over pages, headers carried forward over rows, lines of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def statements(events: DataFrame) -> DataFrame:
    """Statements with the tables that belong to them: document, statement (the id of its title), start_page, end_page, tables and rows.

    events: document, page, y, kind ('statement', 'stop', 'section' or 'table'), event_id and rows. In order of page and y (at one place tables come
    last) a title opens a statement and ends the one before; a stop mark ends it; a section heading ends it once it has a table; a table more than one
    page after its last table ends it and belongs to nothing. Statements without tables are left out.
    """
    order = [F.col("page"), F.col("y"), (F.col("kind") == "table").cast("int"), F.col("event_id")]
    to_here = Window.partitionBy("document").orderBy(*order)
    cut = events.withColumn("part", F.sum(F.col("kind").isin("statement", "stop").cast("int")).over(to_here))
    # within a part, up to the first event that ends it
    inside = Window.partitionBy("document", "part").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    last_table = F.last(F.when(F.col("kind") == "table", F.col("page")), ignorenulls=True).over(before)
    ends = (F.col("kind") == "section") & last_table.isNotNull() | (F.col("kind") == "table") & (F.col("page") - last_table > 1)
    opened = F.first(F.when(F.col("kind") == "statement", F.col("event_id"))).over(inside)
    first_page = F.first("page").over(inside)
    marked = cut.withColumns({"ends": F.coalesce(ends, F.lit(False)).cast("int"), "statement": opened, "start_page": first_page})
    whole = marked.withColumn("ended", F.max("ends").over(inside)).where("statement IS NOT NULL AND ended = 0 AND kind = 'table'")
    return whole.groupBy("document", "statement", "start_page").agg(F.max("page").alias("end_page"), F.count("*").alias("tables"), F.sum("rows").alias("rows"))


#: Rows of a document that are ordered together.
RANGE = 10_000


def carry_forward(rows: DataFrame, group: list[str], at: str, value: Column, reset: Column, name: str, span: int = RANGE) -> DataFrame:
    """The rows with the value last set at or before them in their group, none after a reset until the next value.

    at: whole numbers that order a group. A group is cut into ranges of span places, so no task orders more than that; what the last event of
    each range leaves is carried over its borders by a second pass over one row for each range.
    """
    event = F.when(value.isNotNull(), F.struct(F.lit(True).alias("set"), value.alias("v"))).when(F.coalesce(reset, F.lit(False)), F.struct(F.lit(False).alias("set"), F.lit(None).cast("string").alias("v")))
    ranged = rows.withColumns({"_event": event, "_range": F.floor(F.col(at) / span)})
    own = F.last("_event", ignorenulls=True).over(Window.partitionBy(*group, "_range").orderBy(at))
    left = ranged.where("_event IS NOT NULL").groupBy(*group, "_range").agg(F.max_by("_event", at).alias("_left"))
    every = ranged.select(*group, "_range").distinct().join(left, [*group, "_range"], "left")
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    entering = every.withColumn("_entering", F.last("_left", ignorenulls=True).over(earlier)).select(*group, "_range", "_entering")
    state = F.coalesce("_own", "_entering")
    return ranged.withColumn("_own", own).join(entering, [*group, "_range"]).withColumn(name, F.when(state["set"], state["v"])).drop("_event", "_range", "_own", "_entering")


#: Share of the lower height that must overlap for two spans to be in one line.
SAME_LINE = 0.7


def lines(spans: DataFrame, page: list[str]) -> DataFrame:
    """The spans of each page in reading order: page, span_id, line and place.

    spans: page, span_id, x, y and bottom. From top to bottom a span joins the first line whose first span (the anchor, which never grows) it
    overlaps by SAME_LINE of the lower of both; else it begins a line. Lines come in the order of their anchors, spans in a line by x.
    """
    one = F.struct("y", "x", "span_id", "bottom")
    pages = spans.groupBy(*page).agg(F.array_sort(F.collect_list(one)).alias("spans"))
    height = lambda s: s["bottom"] - s["y"]
    fits = lambda a, s: (F.least(a["bottom"], s["bottom"]) - F.greatest(a["y"], s["y"]) >= SAME_LINE * F.least(height(a), height(s))) & (height(s) > 0) & (height(a) > 0)
    kind = spans.select(one.alias("s")).schema["s"].dataType.simpleString()

    def step(state: Column, s: Column) -> Column:
        met = F.array_position(F.transform(state["anchors"], lambda a: fits(a, s)), True)
        new = met == 0
        line = F.when(new, F.size(state["anchors"]) + 1).otherwise(met).cast("int")
        anchors = F.when(new, F.concat(state["anchors"], F.array(s))).otherwise(state["anchors"])
        return F.struct(anchors.alias("anchors"), F.concat(state["out"], F.array(F.struct(line.alias("line"), s["x"].alias("x"), s["y"].alias("y"), s["span_id"].alias("span_id")))).alias("out"))

    types = dict(spans.dtypes)
    out = f"array<struct<line:int,x:{types['x']},y:{types['y']},span_id:{types['span_id']}>>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("anchors"), F.array().cast(out).alias("out"))
    folded = pages.select(*page, F.array_sort(F.aggregate("spans", start, step, lambda s: s["out"])).alias("out"))
    return folded.select(*page, F.posexplode("out").alias("place", "s")).select(*page, "s.span_id", "s.line", (F.col("place") + 1).alias("place"))
