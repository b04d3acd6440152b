"""Filter interaction audit by lattice edges.

A document is known by which of the five filters it fails, 32 kinds in all. An edge of the lattice is (filters already applied, filter
applied next): 80 edges. Documents are counted by part and kind, each kind adds to the edges it touches, and the 120 orders of the
filters are paths of five edges each: the 600 steps of all orders look their counts up on the edges by one join.

Rules for odd input: a null text is empty; a null source is the empty string; a row without doc_id passes filter E (it comes neither
before nor after any other) and has no label; equal texts under one doc_id do not fail each other; a document with several labels
is good or toxic if any of them says so; repeated rows count each; very long texts are read whole; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
MARKS = r"[#$%&*|]"
#: Hands that the rows without an id are dealt to when labels are looked up.
HANDS = 64
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def fails(text: Column) -> Column:
    """A bit for each of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    chars = F.char_length(text).cast("long")
    capitals = chars - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    found = (n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * chars, text.rlike(MARKS))
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(found)), F.lit(0))


def kinds(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (a bit for each filter), n, good and toxic: documents counted by part and kind."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), fails(text).alias("fails"), F.unhex(F.sha2(text, 256)).alias("digest"))
    hand = F.when(F.col("doc_id").isNull(), F.pmod(F.hash("digest", "part"), F.lit(HANDS)) + 1).otherwise(0)
    # repeated rows become one before they move
    once = rows.groupBy("doc_id", hand.alias("hand"), "part", "fails", "digest").agg(F.count("*").alias("n"))
    label = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).withColumn("hand", F.lit(0))
    labelled = once.join(label, ["doc_id", "hand"], "left").select("doc_id", "part", "fails", "digest", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    # of equal texts only those under the smallest id pass E; equal texts fail A to D alike
    alike = labelled.groupBy("digest", "part", "fails", "good", "toxic").agg(F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"))
    first = F.min("least").over(Window.partitionBy("digest"))
    passing = F.col("no_id") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0)
    split = alike.withColumn("passing", passing).select("part", "good", "toxic", F.explode(F.array(F.struct("fails", F.col("passing").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("passing")).alias("n")))).alias("x"))
    n = F.col("x.n")
    return split.where(n > 0).groupBy("part", F.col("x.fails").alias("fails")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def lattice_edges(counted: DataFrame) -> DataFrame:
    """The counts on the 80 edges (applied, filter) of every part, zeros included, and each filter's removals over all orders."""
    every = [(s, f) for f in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s >> f & 1]
    edges = F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())).alias("orders")) for s, f in every)))
    met = counted.withColumn("edge", edges).select("*", "edge.*")
    bit = F.expr("shiftleft(1, filter)")
    gone, failing = F.col("fails").bitwiseAND(F.col("applied")) != 0, F.col("fails").bitwiseAND(bit) != 0
    removed = ~gone & failing
    cases = (~gone & ~failing, removed, gone & failing, F.col("fails") == bit)
    sums = [F.sum(F.when(x, F.col("n")).otherwise(0)).alias(c) for c, x in zip(COUNTS, cases, strict=False)] + [F.sum(F.when(removed, F.col(c)).otherwise(0)).alias(f"{c}_lost") for c in ("good", "toxic")]
    summed = met.groupBy("part", "applied", "filter", "orders").agg(*sums)
    return summed.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "filter")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and what the filter of that step does there, for every order of the filters."""
    steps = [("".join(FILTERS[f] for f in order), k + 1, sum(1 << f for f in order[:k]), order[k]) for order in permutations(range(len(FILTERS))) for k in range(len(FILTERS))]
    paths = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, filter int")
    return lattice_edges(kinds(docs, labels)).join(F.broadcast(paths), ["applied", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
