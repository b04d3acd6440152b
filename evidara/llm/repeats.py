"""Substring deduplication by repeated-phrase automata.

A passage recurs if WINDOW consecutive words of it occur in documents of different id. Every window has an anchor, the run of ANCHOR
words in it with the least hash, so equal windows have equal anchors, and neighbouring windows mostly share theirs. Anchors
are counted over all documents; what lies around an anchor that several documents have is cut out (a segment) and dealt to a shard by
that anchor, so all occurrences of a window meet in one shard. There the windows found in documents of different ids are
confirmed, compiled into an Aho-Corasick automaton (two characters for each word), and all segments of the shard stream through it: each
match is a place, removed if its document has a larger id than the first that has the window.

Anchors in very many places would make a shard large. Windows around these that are themselves in very many places
go into one automaton that every task has (their number is bounded by all windows over those places); the rest of the windows around such
anchors are dealt each by its own hash. A bit map of the recurring anchors, of bounded size, is broadcast; it says no only of
anchors that do not recur, so if it fills up more segments move and the result is the same.

Rules for odd input: a null or empty text has no words; texts under WINDOW words keep all; very long texts are read whole; windows
in rows of one doc_id do not remove each other, so repeated rows are alike; a row without doc_id comes after all with one; an empty
table gives an empty result; other columns, whatever their names, are kept by remove_repeats. doc_id must be a whole number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.llm.common import SPACE, U64, BitMap, by_size, materialise, mix, row_of, spread

if TYPE_CHECKING:
    import ahocorasick

WINDOW, ANCHOR = 13, 5
#: Places from which an anchor or a window counts as hot: at least LEAST_HOT, and one in HOT_SHARE of all anchors' places.
LEAST_HOT, HOT_SHARE = 4000, 20_000
#: Bytes of text that are read together, anchors that a task holds before it hands them on, and bytes of segments in a shard.
TOGETHER, HELD, SHARD_BYTES = 4_000_000, 2_000_000, 2_000_000
#: Bits of the map for each recurring anchor, and in all.
BITS_EACH, MOST_BITS = 12, 1 << 30
NO_ID = (1 << 63) - 1

BLANK = np.zeros(256, bool)
BLANK[list(SPACE.encode())] = True
BASE = U64(0x9E3779B97F4A7C15)
BACK = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xC2B2AE3D27D4EB4F))


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x)])) for x in (BASE, BACK))


@dataclass
class Words:
    """The words of several texts: bytes, where words start and end in them, their hashes, and each text's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets.astype(np.int64) - offsets[0]
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = ~BLANK[data]
        here, before, after = word[1:-1], word[:-2].copy(), word[2:].copy()
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner] = False
        after[inner - 1] = False
        start, end = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
        size = 1 << max(16, len(data).bit_length())
        up, down = powers(size)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * up[: len(data)], out=total[1:])
        hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        return cls(data, start, end, hashes, np.searchsorted(start, offsets))

    def runs(self, n: int) -> np.ndarray:
        """A hash of each run of n words, whatever text they are in."""
        out = np.zeros(max(0, len(self.hash) - n + 1), np.uint64)
        for i in range(n):
            out = out * BASE + self.hash[i : i + len(out)]
        return mix(out)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where windows begin, the text each is in, and where its anchor begins."""
        runs, n = self.runs(ANCHOR), max(0, len(self.hash) - WINDOW + 1)
        least, at = runs[:n].copy(), np.zeros(n, np.int64)
        for i in range(1, WINDOW - ANCHOR + 1):
            less = runs[i : i + n] < least
            least[less], at[less] = runs[i : i + n][less], i
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        begin = np.flatnonzero(text[:n] == text[WINDOW - 1 :]) if n else at
        return begin, text[begin], begin + at[begin]

    def cut(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """The bytes from word a to before word b, for each pair."""
        start, size = self.start[a], self.end[b - 1] - self.start[a]
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
        return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.data[at])])


def rank(doc_id: Column) -> Column:
    """Ids in order, rows without one last."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def keyed(docs: DataFrame) -> DataFrame:
    """rank and digest, which name a row up to its repetitions, and the text as bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(rank(F.col("doc_id")).alias("rank"), F.xxhash64(text).alias("digest"), text.cast("binary").alias("text"))


def anchor_counts(rows: DataFrame) -> DataFrame:
    """name (the anchor's hash), n, the documents that have it, and places, where it is; repeated rows count each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            if held:
                names, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
                n, places = np.bincount(at), np.bincount(at, np.concatenate([p for _, p in held])).astype(np.int64)
                for i in range(0, len(n), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in (names.view(np.int64), n, places)], ["name", "n", "places"])

        for batch in by_size(batches, TOGETHER):
            words = Words.of(batch["text"])
            _, text, anchor = words.windows()
            # an anchor once, then a hash once for each text
            anchor, at = np.unique(anchor, return_index=True)
            names = words.runs(ANCHOR)[anchor]
            _, once, places = np.unique(mix(names ^ (text[at].astype(np.uint64) + U64(1)) * BASE), return_index=True, return_counts=True)
            held.append((names[once], places))
            size += len(once)
            if size > HELD:
                yield from hand_on()
                held, size = [], 0
        yield from hand_on()

    return rows.select("text").mapInArrow(run, "name long, n long, places long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))


def around_hot(rows: DataFrame, hot: np.ndarray, least: int) -> list[tuple[bytes, int]]:
    """Windows around hot anchors that are in very many places, as words joined by blanks, each with the least rank that has it."""
    sent = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, TOGETHER):
            words = Words.of(batch["text"])
            begin, text, anchor = words.windows()
            some = np.isin(words.runs(ANCHOR)[anchor], sent.value)
            begin, text = begin[some], text[some]
            cut = pc.binary_join(pc.ascii_split_whitespace(words.cut(begin, begin + WINDOW).view(pa.string())), " ")
            # one row for each window of the batch
            found = pa.table({"words": cut, "rank": batch["rank"].to_numpy()[text]}).group_by("words").aggregate([("rank", "min"), ("rank", "max"), ("rank", "count")])
            yield from found.select(["words", "rank_min", "rank_max", "rank_count"]).rename_columns(["words", "lo", "hi", "n"]).combine_chunks().to_batches()

    found = rows.mapInArrow(run, "words string, lo long, hi long, n long").groupBy("words").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    return [(r.words, r.lo) for r in found.where(F.col("n") >= least).where("lo < hi").select("words", "lo").collect()]


def letters(codes: np.ndarray, base: int) -> str:
    """Two characters for each code, as an automaton looks through the characters that go on from a state one by one."""
    x = np.stack([codes // base, codes % base + base], 1).ravel().astype(np.uint32) + 1
    x[x >= 0xD800] += 0x800  # leaving out the surrogates
    return x.tobytes().decode("utf-32-le")


def base_for(codes: np.ndarray) -> int:
    return int((int(codes.max(initial=0)) + 1) ** 0.5) + 1


def automaton(patterns: list[tuple[str, int]]) -> ahocorasick.Automaton:
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for key, value in patterns:
        out.add_word(key, value)
    out.make_automaton()
    return out


class HotPhrases:
    """The automaton of the hot windows, over characters that stand for the words they hold."""

    def __init__(self, phrases: list[tuple[str, int]]) -> None:
        words = Words.of(pa.array([p.encode() for p, _ in phrases], pa.binary()))
        self.known, codes = np.unique(words.hash, return_inverse=True)
        self.base = base_for(codes + 1)
        text = letters(codes + 1, self.base)
        self.automaton = automaton([(text[i : i + 2 * WINDOW], j) for j, i in enumerate(range(0, len(text), 2 * WINDOW))])
        self.first = np.array([f for _, f in phrases], np.int64)

    def places(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Where hot windows begin, and the least rank that has each."""
        at = np.searchsorted(self.known, words.hash).clip(max=len(self.known) - 1)
        codes = np.where(self.known[at] == words.hash, at + 1, 0)
        found = np.array(list(self.automaton.iter(letters(codes, self.base))), np.int64).reshape(-1, 2)
        return found[:, 0] // 2 - WINDOW + 1, self.first[found[:, 1]]


#: Of a Python worker: the automaton of the last run it has seen.
COMPILED: dict[str, HotPhrases] = {}


def spans_of(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from word, to word) of sorted windows, those that follow each other put together."""
    if not len(row):
        return row, start, start
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(row)]]) - 1
    return row[new], start[new], start[last] + WINDOW


SEGMENT = "rank long, digest long, key long, start int, stop int, words binary"


def segments(rows: DataFrame, recurring: BitMap, hot: np.ndarray, phrases: list[tuple[str, int]]) -> DataFrame:
    """What lies around anchors that recur, with the words' place in their text; and the places that hot phrases remove (words null)."""
    sc = rows.sparkSession.sparkContext
    maps, hots, sent = sc.broadcast(recurring), sc.broadcast(hot), sc.broadcast(phrases)
    names, this_run = ["rank", "digest", "key", "start", "stop", "words"], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent.value and this_run not in COMPILED:
            COMPILED.clear()
            COMPILED[this_run] = HotPhrases(sent.value)
        for batch in by_size(batches, TOGETHER):
            words = Words.of(batch["text"])
            begin, text, anchor = words.windows()
            key = words.runs(ANCHOR)[anchor]
            some = maps.value.may_hold(key)
            begin, text, anchor, key = begin[some], text[some], anchor[some], key[some]
            ranks = batch["rank"].to_numpy()
            if len(hots.value):
                alone = np.isin(key, hots.value)
                if sent.value and alone.any():
                    at, first = COMPILED[this_run].places(words)
                    whole = words.first[1:][np.searchsorted(words.first, at, side="right") - 1] >= at + WINDOW
                    at, first = at[whole], first[whole]
                    of = np.searchsorted(words.first, at, side="right") - 1
                    gone = ranks[of] > first
                    row, a, b = spans_of(of[gone], at[gone])
                    if len(row):
                        take = pa.array(row)
                        yield pa.RecordBatch.from_arrays([batch["rank"].take(take), batch["digest"].take(take), batch["rank"].take(take), pa.array((a - words.first[row]).astype(np.int32)), pa.array((b - words.first[row]).astype(np.int32)), pa.nulls(len(row), pa.binary())], names)
                    rest = ~(alone & np.isin(begin, at))
                    begin, text, anchor, key, alone = begin[rest], text[rest], anchor[rest], key[rest], alone[rest]
                key = np.where(alone, words.runs(WINDOW)[begin], key)
                anchor = np.where(alone, -1 - begin, anchor)
            if not len(begin):
                continue
            new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            last = np.concatenate([new[1:], [len(begin)]]) - 1
            a, b, of = begin[new], begin[last] + WINDOW, text[new]
            for i in range(0, len(a), 50_000):
                x, y, t = a[i : i + 50_000], b[i : i + 50_000], of[i : i + 50_000]
                take = pa.array(t)
                yield pa.RecordBatch.from_arrays([batch["rank"].take(take), batch["digest"].take(take), pa.array(key[new[i : i + 50_000]].view(np.int64)), pa.array((x - words.first[t]).astype(np.int32)), pa.array((y - words.first[t]).astype(np.int32)), words.cut(x, y)], names)

    return rows.mapInArrow(run, SEGMENT)


def window_names(codes: np.ndarray) -> np.ndarray:
    """Equal numbers for equal windows and no others: runs of 1, 2, 4, 8 and 13 words are numbered one from another."""

    def pairs(x: np.ndarray, step: int) -> np.ndarray:
        return np.unique(x[:-step] * (int(x.max(initial=0)) + 1) + x[step:], return_inverse=True)[1]

    two = pairs(codes.astype(np.int64), 1)
    four = pairs(two, 2)
    eight = pairs(four, 4)
    return pairs(eight, WINDOW - 8)


def located(shard: pa.Table) -> pa.Table:
    """rank, digest, start and stop of what is to go, of all segments of a shard."""
    shard = shard.combine_chunks()
    ready = shard.filter(pc.is_null(shard["words"])).select(["rank", "digest", "start", "stop"])
    shard = shard.filter(pc.is_valid(shard["words"])).combine_chunks()
    if not shard.num_rows:
        return ready
    coded = shard["words"].combine_chunks()
    coded = (coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
    kind, ranks = coded.indices.to_numpy(), shard["rank"].to_numpy()
    split = pc.ascii_split_whitespace(coded.dictionary.view(pa.string()))
    offsets = split.offsets.to_numpy().astype(np.int64)
    # a separator (code 0) after each segment
    of = np.repeat(np.arange(len(split)), np.diff(offsets))
    codes = np.zeros(offsets[-1] + len(split), np.int64)
    codes[np.arange(offsets[-1]) + of] = split.values.dictionary_encode().indices.to_numpy() + 1
    first = offsets[:-1] + np.arange(len(split))
    size = np.diff(offsets)
    count = size - WINDOW + 1
    begin = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    segment = np.repeat(np.arange(len(split)), count)
    names = np.unique(window_names(codes)[begin], return_inverse=True)[1]
    lo, hi = (np.full(len(split), x) for x in (NO_ID, -NO_ID - 1))
    np.minimum.at(lo, kind, ranks)
    np.maximum.at(hi, kind, ranks)
    least, most = (np.full(names.max() + 1, x) for x in (NO_ID, -NO_ID - 1))
    np.minimum.at(least, names, lo[segment])
    np.maximum.at(most, names, hi[segment])
    confirmed = np.flatnonzero(least < most)
    if not len(confirmed):
        return ready
    text = letters(codes, base_for(codes))
    place = np.zeros(len(least), np.int64)
    place[names] = begin
    found = automaton([(text[2 * i : 2 * (i + WINDOW)], j) for i, j in zip(place[confirmed].tolist(), confirmed.tolist(), strict=True)]).iter(text)
    matches = np.fromiter((x for pair in found for x in pair), np.int64).reshape(-1, 2)
    at, earliest = matches[:, 0] // 2 - WINDOW + 1, least[matches[:, 1]]
    inside = np.searchsorted(first, at, side="right") - 1
    # every row of the shard has the matches of its segment
    begins, per = np.searchsorted(inside, np.arange(len(split))), np.bincount(inside, minlength=len(split))
    row = np.repeat(np.arange(len(kind)), per[kind])
    match = np.arange(len(row)) + np.repeat(begins[kind] - np.concatenate([[0], np.cumsum(per[kind])[:-1]]), per[kind])
    gone = ranks[row] > earliest[match]
    row, match = row[gone], match[gone]
    row, a, b = spans_of(row, shard["start"].to_numpy()[row] + at[match] - first[kind[row]])
    take = pa.array(row)
    out = pa.table([shard["rank"].take(take), shard["digest"].take(take), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["rank", "digest", "start", "stop"])
    return pa.concat_tables([ready, out])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """rank, digest (see keyed) and spans, (start, stop) in words, of all documents that repeat a window of one with a smaller id."""
    spark = docs.sparkSession
    rows = spread(keyed(docs))
    anchors = materialise(anchor_counts(rows).where("n > 1"), "anchors")
    size = anchors.agg(F.count("*").alias("n"), F.sum("places").alias("all")).first()
    least = max(LEAST_HOT, (size["all"] or 0) // HOT_SHARE)
    hot = np.array(sorted(r.name for r in anchors.where(F.col("places") >= least).select("name").collect()), np.int64).view(np.uint64)
    recurring = BitMap.of(anchors.select("name"), min(MOST_BITS, max(1 << 20, 1 << (size.n * BITS_EACH).bit_length())))
    phrases = around_hot(rows, hot, least) if len(hot) else []
    found = segments(rows, recurring, hot, phrases)
    # about three words of a segment for each anchor that several documents have
    shards = max(spark.sparkContext.defaultParallelism, (size["all"] or 0) * 100 // SHARD_BYTES)
    spans = found.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(lambda t: located(t.drop_columns(["shard"])), "rank long, digest long, start int, stop int")
    return spans.groupBy("rank", "digest").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All columns of the documents as row, without the text; text, the words kept joined by one space; n_words and n_removed."""
    others = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    rows = spread(docs).select(row_of(docs, others).alias("row"), rank(F.col("doc_id")).alias("rank"), F.xxhash64(text).alias("digest"), text.cast("binary").alias("text"))
    joined = rows.join(repeated_spans(docs).hint("shuffle_hash"), ["rank", "digest"], "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, TOGETHER):
            kept, n, removed = [], [], []
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                words = text.split()
                n.append(len(words))
                if spans:
                    gone = np.zeros(len(words), bool)
                    for s in spans:
                        gone[s["start"] : s["stop"]] = True
                    words = [words[i] for i in np.flatnonzero(~gone)]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(kept, pa.binary()).view(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], ["row", "text", "n_words", "n_removed"])

    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(run, schema)
