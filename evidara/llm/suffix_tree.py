"""LM scoring by a probabilistic suffix tree over words.

The root is the add-one unigram over all training tokens. A context (up to DEPTH words) that occurs often enough is tested: if
what follows it diverges enough from what follows its own suffix, it is retained, and its suffixes with it. A retained
context knows the next words that follow it often enough; the mass it does not spend on them goes to its suffix, in the
suffix's proportions, so each distribution sums to one. A text is scored with the longest retained suffix at each token.

Every word is a symbol of its own, and what is often enough grows with the square root of the training tokens only: so what is gathered
grows with the corpus, about as its square root, while estimates get surer. It stays in tables: grams of one word more are
counted from those of one word fewer. The gain over the root of a token is the sum of a
value for each gram that ends at it and one for each that ends before it, so a text's score is the sum of its grams' values: one
look-up by join. Two things of fixed size are broadcast: the values of the most frequent words and grams (by share of the corpus, so
that no hot key is joined), and bit maps that tell most grams that are not in a table. On a corpus so large that the
maps fill up, results are the same, but all grams are shuffled: some 25 bytes a token and depth instead of about 10.

Words and grams are named by 64-bit hashes. Rules for odd input: a null or empty text has the end token alone; very long texts are
scored whole; repeated rows count and are scored each; ties need no rule; a null id hashes as the empty text; without training rows
every probability is that of an unknown word among none (1, log 0); an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from evidara.llm.common import U64, BitMap, forget, materialise, remainder_of_id, small, spread, text_bytes

DEPTH = 3
#: Occurrences of a context that is tested and of an entry that is kept, for each root of the training tokens.
ROOT_CONTEXT, ROOT_ENTRY = 0.2, 0.005
#: Occurrences times divergence (natural log) that keep a context, and what is taken off each entry's count.
LEAST_GAIN, DISCOUNT = 20.0, 0.5
#: Shares of the training tokens from which words and grams are broadcast: at most 1/share of each.
TOP_WORD, TOP_GRAM = 5e-7, 1e-6
#: Bits of a map: a fixed size (4 MB), whatever the corpus.
BITS = 1 << 25
#: Grams that a counting task holds before it merges and hands them on, and rows that are read together.
HELD, TOGETHER = 2_000_000, 1000
#: The end of a text, as the hash of the empty word, which no text holds.
END = U64(xxh3_64_intdigest(b""))
#: Constants of the public 64-bit xxHash, by which Spark names a gram from its context and its suffix.
P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def thresholds(total: int) -> tuple[float, float]:
    """Least occurrences of a context and of an entry."""
    return max(2.0, ROOT_CONTEXT * total**0.5), max(2.0, ROOT_ENTRY * total**0.5)


def rotated(x: np.ndarray, n: int) -> np.ndarray:
    return x << U64(n) | x >> U64(64 - n)


def named(ctx: np.ndarray, suf: np.ndarray) -> np.ndarray:
    """The same as F.xxhash64(ctx, suf)."""
    out: np.ndarray | np.uint64 = U64(42)
    for x in (ctx, suf):
        h = (out + P5 + U64(8)) ^ rotated(x * P2, 31) * P1
        h = rotated(h, 27) * P1 + P4
        h = (h ^ h >> U64(33)) * P2
        h = (h ^ h >> U64(29)) * P3
        out = h ^ h >> U64(32)
    return out


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text's end token last, and where each text begins."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    coded = words.values.dictionary_encode()
    distinct = np.fromiter(map(xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = distinct[coded.indices.to_numpy()]
    # splitting leaves an empty word at a rim of white space (and in an empty text)
    there = h != END
    stops = np.r_[0, np.cumsum(there)][words.offsets.to_numpy() - words.offsets[0].as_py()]
    begins = stops + np.arange(len(stops))
    out = np.full(begins[-1], END, np.uint64)
    kept = np.flatnonzero(there)
    out[np.arange(len(kept)) + np.searchsorted(stops[1:], np.arange(len(kept)), side="right")] = h[kept]
    return out, begins


def grams(h: np.ndarray, begins: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For lengths from 2 to most: places in h where such grams end, their contexts, their suffixes and their names."""
    place, name = np.arange(len(h)), h
    starts = np.zeros(len(h) + 1, bool)
    starts[begins] = True
    for n in range(2, most + 1):
        # a gram goes on with the next token of the same text
        fits = np.flatnonzero(~starts[place[:-1] + 1] & (place[1:] == place[:-1] + 1)) if len(place) else place
        ctx, suf = name[fits], name[fits + 1]
        place, name = place[fits + 1], named(ctx, suf)
        yield place, ctx, suf, name


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """name, ctx, suf and n of parts, each name once."""
    name, ctx, suf, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    name, first, at = np.unique(name, return_index=True, return_inverse=True)
    return name, ctx[first], suf[first], np.bincount(at, n, minlength=len(name)).astype(np.int64)


def held_and_handed_on(found: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """ctx, suf and n of grams that come as names, contexts and suffixes, merged now and then."""
    held, size = [], 0

    def hand_on() -> Iterator[pa.RecordBatch]:
        if held:
            _, ctx, suf, n = merged(held)
            for i in range(0, len(n), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(ctx[i : i + 50_000].view(np.int64)), pa.array(suf[i : i + 50_000].view(np.int64)), pa.array(n[i : i + 50_000])], ["ctx", "suf", "n"])

    for name, ctx, suf in found:
        held.append((name, ctx, suf, np.ones(len(name), np.int64)))
        size += len(name)
        if size > HELD:
            yield from hand_on()
            held, size = [], 0
    yield from hand_on()


def word_counts(docs: DataFrame) -> DataFrame:
    """name (the word's hash) and n over all rows of docs, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from held_and_handed_on((h, h, h) for h, _ in (tokens(b["text"]) for b in small(batches, TOGETHER)))

    return text_bytes(docs).mapInArrow(run, "ctx long, suf long, n long").groupBy(F.col("ctx").alias("name")).agg(F.sum("n").alias("n"))


def longer(docs: DataFrame, length: int, shorter: DataFrame, least_context: float, least_entry: float) -> DataFrame:
    """The grams of so many words, from those of one word fewer: each with its count (n), its context's and suffix's (of), the
    suffix's empirical chance (q) and the last word's at the root (root)."""
    spark = docs.sparkSession
    contexts = spark.sparkContext.broadcast(BitMap.of(shorter.where(F.col("n") >= least_context).select("name"), BITS))
    entries = spark.sparkContext.broadcast(BitMap.of(shorter.select("name"), BITS))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in small(batches, TOGETHER):
            *_, (_, ctx, suf, name) = grams(*tokens(batch["text"]), length)
            some = contexts.value.may_hold(ctx)
            some[some] = entries.value.may_hold(suf[some])
            yield name[some], ctx[some], suf[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from held_and_handed_on(found(batches))

    counted = text_bytes(docs).mapInArrow(run, "ctx long, suf long, n long").groupBy("ctx", "suf").agg(F.sum("n").alias("n")).where(F.col("n") >= least_entry)
    counted = materialise(counted.withColumn("name", F.xxhash64("ctx", "suf")), "grams")
    of_ctx = shorter.where(F.col("n") >= least_context).select(F.col("name").alias("ctx"), F.col("n").alias("of"))
    of_suf = shorter.select(F.col("name").alias("suf"), "root", F.col("p").alias("q"))
    out = counted.join(of_ctx, "ctx").join(of_suf, "suf")
    level = materialise(out.select("name", "ctx", "suf", "n", "of", "root", "q", (F.col("n") / F.col("of")).alias("p")), "grams")
    forget(counted)
    return level


@dataclass
class Tree:
    """name and value of the retained grams and contexts; a text's gain over the root is the sum over all its grams."""

    values: DataFrame
    total: int
    distinct: int

    @property
    def below(self) -> float:
        return float(np.log10(self.total + self.distinct + 1.0))


def tested(level: DataFrame) -> DataFrame:
    """ctx of the contexts whose next words diverge from those of their suffix."""
    p, q = (F.col("n") - DISCOUNT) / F.col("of"), F.col("q")
    sums = level.groupBy("ctx").agg(F.max("of").alias("of"), F.sum(p).alias("p"), F.sum(q).alias("q"), F.sum(p * F.log(p / q)).alias("d"))
    rest, rest_q = F.greatest(1 - F.col("p"), F.lit(1e-12)), F.greatest(1 - F.col("q"), F.lit(1e-12))
    return sums.where(F.col("of") * (F.col("d") + rest * F.log(rest / rest_q)) >= LEAST_GAIN).select("ctx")


def grow(docs: DataFrame, counts: DataFrame) -> Tree:
    """The tree of the training rows, from their word counts."""
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    tree = Tree(counts, whole.total, whole.distinct)
    least_context, least_entry = thresholds(tree.total)
    root = F.log10(F.col("n") + 1.0) - F.lit(tree.below)
    shorter = counts.where(F.col("n") >= least_entry).select("name", "n", root.alias("root"), F.pow(F.lit(10.0), root).alias("p"))
    levels = []
    for length in range(2, DEPTH + 2):
        shorter = longer(docs, length, shorter, least_context, least_entry)
        levels.append(shorter)
    # a context is retained for its own sake or as the suffix of a retained one
    retained, deeper = [], None
    for i in range(DEPTH - 1, -1, -1):
        own = tested(levels[i])
        if deeper is not None:
            own = own.union(levels[i].join(deeper.select(F.col("ctx").alias("name")), "name", "left_semi").select(F.col("suf").alias("ctx"))).distinct()
        deeper = materialise(own, "retained")
        retained.insert(0, deeper)
    # top down: an entry's gain over the root, what its suffix's would be, and the share that backs off
    values, upper, written = [], None, []
    for i, level in enumerate(levels):
        kept = level.join(retained[i], "ctx", "left_semi").withColumn("gain", F.log10((F.col("n") - DISCOUNT) / F.col("of")) - F.col("root"))
        kept = kept.withColumn("by_suffix", F.lit(0.0)) if upper is None else kept.join(upper.select(F.col("name").alias("suf"), F.col("gain").alias("by_suffix")), "suf")
        kept = materialise(kept, "entries")
        spent = kept.groupBy("ctx").agg(F.max("of").alias("of"), F.sum((F.col("n") - DISCOUNT) / F.col("of")).alias("p"), F.sum(F.pow(F.lit(10.0), F.col("root") + F.col("by_suffix"))).alias("q"))
        alpha = materialise(spent.select("ctx", "of", F.log10(F.greatest(1 - F.col("p"), F.lit(1e-12)) / F.greatest(1 - F.col("q"), F.lit(1e-12))).alias("alpha")), "alpha")
        values += [alpha.select(F.col("ctx").alias("name"), F.col("of").alias("n"), F.col("alpha").alias("value"), F.lit(i + 1).alias("length"))]
        values += [kept.join(alpha.select("ctx", "alpha"), "ctx").select("name", "n", (F.col("gain") - F.col("alpha") - F.col("by_suffix")).alias("value"), F.lit(i + 2).alias("length"))]
        upper = kept
        written += [kept, alpha]
    all_of = values[0]
    for more in values[1:]:
        all_of = all_of.unionByName(more)
    tree.values = materialise(all_of.groupBy("name", "length").agg(F.max("n").alias("n"), F.sum("value").alias("value")), "values")
    forget(*levels, *retained, *written)
    return tree


class Top:
    """Names with two numbers each, sorted."""

    def __init__(self, rows: pa.Table, *columns: str) -> None:
        name = rows["name"].to_numpy().view(np.uint64)
        order = np.argsort(name)
        self.name = name[order]
        self.columns = [np.append(rows[c].to_numpy()[order], 0.0) for c in columns]

    def at(self, names: np.ndarray) -> np.ndarray:
        """The place of each name; the last place, of zeros, if it is not there."""
        at = np.searchsorted(self.name, names)
        there = at < len(self.name)
        there[there] = self.name[at[there]] == names[there]
        return np.where(there, at, len(self.name))


def looked_up(docs: DataFrame, counts: DataFrame, tree: Tree, held_out: Column) -> DataFrame:
    """Each document with the sums over its most frequent words and grams, and the names left to look up with their numbers."""
    send = docs.sparkSession.sparkContext.broadcast
    alpha = tree.values.where("length = 1").select("name", "value")
    words = materialise(counts.join(alpha, "name", "left").select("name", "n", F.log10(F.col("n") + 1.0).alias("log"), F.coalesce("value", F.lit(0.0)).alias("value")), "words")
    of_grams = tree.values.where("length > 1").select("name", "n", "value")
    top_word, top_gram = TOP_WORD * tree.total, TOP_GRAM * tree.total
    top = send((Top(words.where(F.col("n") >= top_word).select("name", "log", "value").toArrow(), "log", "value"), Top(of_grams.where(F.col("n") >= top_gram).select("name", "value").toArrow(), "value")))
    known = send(BitMap.of(of_grams.select("name"), BITS))
    rows = text_bytes(docs, F.col("doc_id"), held_out.alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "logs", "gain", "names", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (top_words, top_grams), grams_known = top.value, known.value
        for batch in small(batches, TOGETHER):
            h, begins = tokens(batch["text"])
            doc = np.repeat(np.arange(batch.num_rows), np.diff(begins))
            distinct, code = np.unique(h, return_inverse=True)
            at = top_words.at(distinct)[code]
            found = at < len(top_words.name)
            sums = [np.bincount(doc, found, minlength=batch.num_rows)] + [np.bincount(doc, c[at], minlength=batch.num_rows) for c in top_words.columns]
            left = [(doc[~found], h[~found])]
            for place, _, _, name in grams(h, begins, DEPTH + 1):
                some = np.flatnonzero(grams_known.may_hold(name))
                at = top_grams.at(name[some])
                hit = at < len(top_grams.name)
                sums[2] = sums[2] + np.bincount(doc[place[some]], top_grams.columns[0][at], minlength=batch.num_rows)
                left.append((doc[place[some[~hit]]], name[some[~hit]]))
            owner, name = (np.concatenate(x) for x in zip(*left, strict=True))
            order = np.lexsort((name, owner))
            owner, name = owner[order], name[order]
            first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (name[1:] != name[:-1])]) if len(name) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(name)])
            offsets = pa.array(np.searchsorted(owner[first], np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (name[first].view(np.int64), times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(np.diff(begins)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(float)), pa.array(sums[2].astype(float)), *lists], names)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, gain double, names array<long>, times array<long>"
    out = materialise(rows.mapInArrow(run, schema).withColumn("number", F.monotonically_increasing_id()), "scored")
    # no name that is left is frequent, so the join has no hot keys
    table = words.where(F.col("n") < top_word).select("name", F.lit(1).alias("is_word"), "log", "value").unionByName(of_grams.where(F.col("n") < top_gram).select("name", F.lit(0).alias("is_word"), F.lit(0.0).alias("log"), "value"))
    each = out.select("number", F.explode(F.arrays_zip("names", "times")).alias("x")).select("number", F.col("x.names").alias("name"), F.col("x.times").alias("times"))
    more = each.join(table, "name").groupBy("number").agg(F.sum(F.col("times") * F.col("is_word")).alias("more_known"), F.sum(F.col("times") * F.col("log")).alias("more_logs"), F.sum(F.col("times") * F.col("value")).alias("more_gain"))
    sums = [(F.col(c) + F.coalesce(f"more_{m}", F.lit(0))).alias(c) for c, m in (("n_known", "known"), ("logs", "logs"), ("gain", "gain"))]
    return out.drop("names", "times").join(more, "number", "left").select("doc_id", "held_out", "n_tokens", *sums)


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the root's) and score (the tree's) of each document."""
    docs = spread(docs)
    held_out = remainder_of_id(F.col("doc_id"), folds) == held
    training = docs.where(~held_out)
    counts = materialise(word_counts(training), "counts")
    tree = grow(training, counts)
    base = F.col("logs") - F.col("n_tokens") * F.lit(tree.below)
    out = looked_up(docs, counts, tree, held_out).withColumn("base_score", base)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("gain")).alias("score"))
