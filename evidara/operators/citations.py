"""What answers claim against the evidence that they cite, and the earlier requests that follow-up questions point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import grounding as G
from evidara.functions.text import column
from evidara.operators.layout import carry_forward

#: Words with which an answer speaks of growth.
GROWTH = ["growth", "increase", "decrease", "yoy", "qoq", "同比", "环比", "增长"]


def supported_evidence(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """question_id, place, support ('supported', 'unverified' or null) of the evidence that stays with each answer.

    candidates: question_id, place (1 is the best) and content; answers: question_id and answer. An answer without numbers keeps all
    its evidence, unjudged. Else what has one of its numbers stays, or, where the answer speaks of growth, what has two amounts first whose growth it
    states; if nothing does, the best candidate alone stays, unverified. A question's candidates are what a retrieval returned, a bounded
    number; answers without candidates have no rows; a null answer or content has no numbers.
    """
    said = answers.select("question_id", G.numbers("answer").alias("_claims"), F.exists(F.array(*map(F.lit, GROWTH)), lambda w: F.contains(F.lower("answer"), w)).alias("_growth"))
    read = candidates.select("question_id", "place", G.numbers("content").alias("_numbers")).join(said, "question_id")
    first, second = F.get("_numbers", 0), F.get("_numbers", 1)
    rate = F.struct(G.growth_of(first, second).cast(G.MONEY).alias("value"), F.lit("percent").alias("kind"), F.lit(None).cast("string").alias("currency"), F.lit(None).cast(G.MONEY).alias("quantum"))
    derived = F.col("_growth") & (first["kind"] == "amount") & (second["kind"] == "amount") & (second["value"] != 0) & G.any_equivalent(F.col("_claims"), F.array(rate))
    judged = read.select("question_id", "place", (F.size("_claims") > 0).alias("_judged"), (G.any_equivalent(F.col("_claims"), F.col("_numbers")) | F.coalesce(derived, F.lit(False))).alias("_held"))
    whole = Window.partitionBy("question_id")
    seen = judged.withColumns({"_any": F.max("_held").over(whole), "_best": F.min("place").over(whole)})
    support = F.when(~F.col("_judged"), None).when(F.col("_held"), "supported").otherwise("unverified")
    stays = ~F.col("_judged") | F.col("_held") | ~F.col("_any") & (F.col("place") == F.col("_best"))
    return seen.where(stays).select("question_id", "place", support.alias("support"))


def claim_coverage(answer: Column | str, claims: Column | str) -> Column:
    """Per cent of the claims that an answer holds word for word, in any case; 100 without claims, and a null answer is empty."""
    a, c = F.lower(F.coalesce(column(answer), F.lit(""))), F.coalesce(column(claims), F.array().cast("array<string>"))
    held = F.size(F.filter(c, lambda x: F.contains(a, F.lower(x))))
    return F.when(F.size(c) == 0, F.lit(100.0)).otherwise(F.round(held / F.size(c) * 100, 1))


def plain_words(text: Column | str) -> Column:
    """The letters and digits of ASCII in lower case, as words."""
    return F.regexp_extract_all(F.lower(F.coalesce(column(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def lexical_quality(response: Column | str, terms: Column | str, reference: Column | str) -> Column:
    """Per cent of the expected terms that a response holds; without terms, of the reference's distinct words; with neither, 100 unless it is blank."""
    r, t = column(response), F.coalesce(column(terms), F.array().cast("array<string>"))
    flat = F.array_join(plain_words(r), " ")
    held = F.size(F.filter(t, lambda x: F.contains(flat, F.array_join(plain_words(x), " "))))
    wanted = F.array_distinct(plain_words(reference))
    shared = F.size(F.array_intersect(wanted, plain_words(r)))
    by_words = F.when(F.size(wanted) == 0, F.lit(100.0)).otherwise(F.round(shared * 100 / F.size(wanted), 2))
    alone = F.when(F.trim(F.coalesce(r, F.lit(""))) != "", F.lit(100.0)).otherwise(0.0)
    return F.when(F.size(t) > 0, F.round(held * 100 / F.size(t), 2)).when(F.coalesce(column(reference), F.lit("")) != "", by_words).otherwise(alone)


def prior_requests(turns: DataFrame, refers: Column, entities: Column) -> DataFrame:
    """conv_id, turn, prior_turn and entities of each user turn that refers back to an earlier request.

    turns: conv_id, turn (from 0), role and text; refers: whether a text points back; entities: the names in it, as an array of strings.
    Going back over the user's turns, blank ones passed over, the first that names something is what is meant; the first
    that neither names anything nor points back itself begins another topic, and nothing is meant. Of rows that share a turn the one with the greatest
    text counts; rows without a turn or conversation are left out. A conversation may have any length: it is ordered in ranges.
    """
    own = turns.where((F.lower("role") == "user") & (F.trim("text") != "") & F.col("turn").isNotNull() & F.col("conv_id").isNotNull())
    own = own.groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    own = own.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(refers, F.lit(False)).alias("refers"), F.coalesce(entities, F.array().cast("array<string>")).alias("names"))
    # a turn asks at an even place, before it is itself there to be found at the odd one
    parts = F.array(F.struct((F.col("turn") * 2).alias("at"), F.lit(True).alias("asks")), F.struct((F.col("turn") * 2 + 1).alias("at"), F.lit(False).alias("asks")))
    placed = own.select("conv_id", "turn", "refers", "names", F.explode(parts).alias("p")).select("conv_id", "turn", "refers", "names", "p.*").where("refers OR NOT asks")
    named = F.when(~F.col("asks") & (F.size("names") > 0), F.to_json(F.struct("turn", "names")))
    topic = ~F.col("asks") & (F.size("names") == 0) & ~F.col("refers")
    carried = carry_forward(placed, ["conv_id"], "at", named, topic, "found").where("asks AND found IS NOT NULL")
    return carried.withColumn("found", F.from_json("found", "turn long, names array<string>")).select("conv_id", "turn", F.col("found.turn").alias("prior_turn"), F.col("found.names").alias("entities"))
