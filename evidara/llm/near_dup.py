"""Near-duplicates: a set similarity join by chosen paths, with exact confirmation on full shingle sets.

1. Equal shingle sets are one class; the rest works on classes.
2. Every class has SIZE minwise values. In each tree a node chooses one position, or with some chance two; a class goes to the
   child named by its value there. How a path begins depends on the class alone, so the first levels need no shuffle. Below
   them two positions are likelier, so that similar pairs survive at any depth.
3. Every class is compared with its node's least class; candidates whose sketches agree are confirmed on the full sets, and
   the links found make coarse components.
4. Only nodes that hold more than one component go on. One of up to SMALL classes is compared exhaustively across its
   components: sketches find the groups in doubt, and full sets are compared within each group, however many nodes it meets in,
   which gives only as many links as join its components. In a larger one every class is compared with a few leaders of other components, and the node
   branches on until it is small or within one component. No partner or candidate is ever capped.

The trees share the minwise values, whose agreement varies between pairs. Averaged over that, a pair of the least similarity
meets in no tree with a chance of about 6e-5 where nodes are small after the first levels, and of about 2e-2 at worst where they
stay large without end (at similarity 0.85: 5e-6 and 1.5e-3). Other links of its group may still join such a pair.

Rules for odd input: a text without words (or null) has no shingles and is linked with nothing; a text of fewer words than a
shingle has is one shingle; repeated rows are linked with each other; rows of one id with different texts are told apart by
their sets; a null id is its own component unless linked; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from evidara.llm.common import U64, forget, lean, materialise, mix, row_of, small, spread, text_bytes

#: Minwise values that paths choose from, and values of which a bit each is kept to compare classes.
SIZE, CHECKS = 64, 256
TREES = 12
#: Levels of the paths before nodes are first counted, and levels between two confirmations after that.
FIRST_LEVELS = 3
NEXT_LEVELS = 3
#: One node in so many chooses a second position: in the first levels, and below them.
FIRST_SECONDS, NEXT_SECONDS = 4, 2
#: Classes in a node that is compared exhaustively; leaders of a larger node.
SMALL = 8192
LEADERS = 4
#: Sets of up to so many shingles go to their nodes; larger ones are looked up for each pair. Bounds a node to 64 MiB of sets.
SET_MOST = 1024
#: Sets that one is compared with before what they join counts as one.
AT_ONCE = 64
#: Bits of the filter for wanted ids: a fixed size, so it can be broadcast at any scale.
MARKS = 1 << 24
#: Of 64 sketch bits, pairs of similarity 0.8 agree on 57.6 on average (deviation 2.4); of CHECKS bits, on 230.4 (4.8).
LEAST_AGREEING, LEAST_LIKE = 45, 209
#: Shingle sets that a confirming task remembers.
REMEMBERED_BYTES = 64_000_000
MULTIPLIERS = (mix(np.arange(1, CHECKS + 1, dtype=np.uint64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
ADDENDS = (mix(np.arange(1001, CHECKS + 1001, dtype=np.uint64)) >> U64(32)).astype(np.uint32)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of width words, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, len(words) if len(words) < width else width, np.uint64)
    for i in range(min(width, len(words))):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """CHECKS minwise values of a set, in blocks so that a very long text needs little memory."""
    x = (mix(shingles) >> U64(32)).astype(np.uint32)
    least = np.full(CHECKS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, (x[i : i + 512, None] * MULTIPLIERS + ADDENDS).min(axis=0), out=least)
    return least


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        a, b = mix(shingles + U64(17)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(shingles * U64(0xD6E8FEB86659FD93)))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, key (hi, lo), minwise values, check bits and the sketch of every row; null key without words."""
    rows = text_bytes(docs, F.col("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n, hi, lo, sig, check, bits = [], [], [], [], [], []
            for text in batch["text"].to_pylist():
                s = shingle_set(text, width)
                n.append(len(s))
                if len(s):
                    m = minwise(s)
                    a, b = set_key(s)
                    hi.append(a)
                    lo.append(b)
                    sig.append(m[:SIZE].tobytes())
                    check.append(np.packbits((mix(m.astype(np.uint64)) >> U64(7)).astype(np.uint8) & 1, bitorder="little").tobytes())
                    bits.append(int.from_bytes(check[-1][: SIZE // 8], "little", signed=True))
                else:
                    for x in (hi, lo, sig, check, bits):
                        x.append(None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary()), pa.array(check, pa.binary()), pa.array(bits, pa.int64())], ["doc_id", "n", "hi", "lo", "sig", "check", "bits"])

    return rows.mapInArrow(lean(run), f"doc_id {kind}, n long, hi long, lo long, sig binary, check binary, bits long")


def step(nodes: np.ndarray, sig: np.ndarray, seconds: int = FIRST_SECONDS) -> tuple[np.ndarray, np.ndarray]:
    """Children of each (node, class): their nodes, and the rows that they come from.

    A node always chooses one position and one node in so many (seconds) another. With 4 that is 1 / 0.8 on average: a pair of
    the least similarity neither dies out nor multiplies. With 2 such a pair multiplies by 1.2 a level, so it has a fair chance
    to live on at any depth, while pairs below 2/3 die out. The choice depends on the node alone.
    """
    rows = np.arange(len(nodes))
    draw = mix(nodes + U64(0x51ED270B))
    first = (draw % U64(SIZE)).astype(np.int64)
    second = (first + 1 + ((draw >> U64(20)) % U64(SIZE - 1)).astype(np.int64)) % SIZE
    two = (draw >> U64(40)) % U64(seconds) == 0
    at, pos = np.concatenate([rows, rows[two]]), np.concatenate([first, second[two]])
    return mix(nodes[at] * U64(0x9E3779B97F4A7C15) + mix(sig[at, pos].astype(np.uint64) + (pos.astype(np.uint64) << U64(40)))), at


def branch(rows: DataFrame, levels: int, roots: int = 0) -> DataFrame:
    """node, cls and bits, some levels down from the rows' nodes (or from the roots of so many trees)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint32).reshape(-1, SIZE)
            cls, bits = batch["cls"].to_numpy(), batch["bits"].to_numpy()
            if roots:
                owner = np.repeat(np.arange(len(cls)), roots)
                nodes = np.tile(mix(np.arange(1, roots + 1, dtype=np.uint64)), len(cls))
            else:
                owner, nodes = np.arange(len(cls)), batch["node"].to_numpy().view(np.uint64)
            for _ in range(levels):
                nodes, at = step(nodes, sig[owner], FIRST_SECONDS if roots else NEXT_SECONDS)
                owner = owner[at]
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(cls[owner]), pa.array(bits[owner])], ["node", "cls", "bits"])

    return rows.mapInArrow(lean(run), "node long, cls long, bits long")


def agree(a: str, b: str) -> F.Column:
    """Whether two sketches may belong to a similar pair."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 64 - LEAST_AGREEING


def by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole nodes, from rows that come sorted by node: the rows after the last change of node wait for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch["node"].to_numpy()
        change = np.flatnonzero(node[1:] != node[:-1])
        if held and held[-1]["node"][-1].as_py() != node[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            yield pa.Table.from_batches([*held, batch.slice(0, int(change[-1]) + 1)])
            held, batch = [], batch.slice(int(change[-1]) + 1)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


class Node:
    """The classes of one small node, those of its largest component last: these need no comparison with each other."""

    def __init__(self, rows: pa.Table) -> None:
        comp = rows["comp"].to_numpy()
        _, at, sizes = np.unique(comp, return_inverse=True, return_counts=True)
        order = np.argsort(at == sizes.argmax(), kind="stable")
        self.first = int(len(comp) - sizes.max())
        self.rows = rows.take(order)
        self.cls, self.comp = self.rows["cls"].to_numpy(), comp[order]
        self.bits = self.rows["bits"].to_numpy().view(np.uint64)
        self.check = np.frombuffer(b"".join(self.rows["check"].to_pylist()), np.uint64).reshape(-1, CHECKS // 64)

    def like(self, i: int) -> np.ndarray:
        """Places after i of the classes of other components whose sketches are like that of i, the most alike first."""
        rest = slice(i + 1, None)
        near = np.flatnonzero((self.comp[rest] != self.comp[i]) & (np.bitwise_count(self.bits[rest] ^ self.bits[i]) <= 64 - LEAST_AGREEING)) + i + 1
        apart = np.bitwise_count(self.check[near] ^ self.check[i]).sum(axis=1, dtype=np.int64)
        order = np.argsort(apart, kind="stable")
        return near[order][apart[order] <= CHECKS - LEAST_LIKE]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are like one of another component, and a name of each row's group: all that are alike, one by way of another.

        The name depends on the group's classes alone, so that a group which meets in several nodes has one name.
        """
        group, some = np.arange(len(self.cls)), np.zeros(len(self.cls), bool)
        for i in range(self.first):
            if len(near := self.like(i)):
                some[i] = some[near] = True
                if len(others := np.unique(group[near][group[near] != group[i]])):
                    group[np.isin(group, others)] = group[i]
        total = np.zeros(len(group), np.uint64)
        np.add.at(total, group, mix(self.cls.astype(np.uint64) + U64(29)))
        return some, mix(total[group])


def nodes_of(table: pa.Table) -> Iterator[Node]:
    node = table["node"].to_numpy()
    cuts = np.r_[0, np.flatnonzero(node[1:] != node[:-1]) + 1, len(node)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield Node(table.slice(i, j - i))


def in_doubt(small: DataFrame, checks: DataFrame) -> DataFrame:
    """node, cls, bits, comp and check of the rows of small nodes that are like a row of another component.

    From here on a node is a group of such rows. Similar classes meet in many nodes, but mostly with the same others: they are one
    group then, and are compared once.
    """
    kept = small.select("node", "cls", "bits", "comp").join(checks, "cls").select("node", "cls", "bits", "comp", "check")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_node(batches):
            for x in nodes_of(table):
                some, group = x.groups()
                if some.any():
                    yield from x.rows.set_column(0, "node", pa.array(group.view(np.int64))).filter(pa.array(some)).combine_chunks().to_batches()

    found = kept.repartition(F.col("node")).sortWithinPartitions("node", "cls").mapInArrow(lean(run), "node long, cls long, bits long, comp long, check binary")
    return found.dropDuplicates(["node", "cls"])


def exhaustive(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each small node: all sets that are like each other are compared in full.

    Within a node what a link joins is one component from then on, so a node has fewer links than classes. Where a set is
    missing, as it is large, the pair comes out unsure, for confirm().
    """

    def linked_to(x: Node, i: int, near: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(sets[j]) for j in near])
        all_of = np.concatenate([sets[j] for j in near])
        at = np.minimum(np.searchsorted(sets[i], all_of), len(sets[i]) - 1)
        both = np.add.reduceat((sets[i][at] == all_of).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
        return 100 * both >= percent * (len(sets[i]) + sizes - both)

    def compare(x: Node) -> Iterator[tuple[int, int, bool]]:
        sets = [None if v is None else np.frombuffer(v, np.uint64) for v in x.rows["shingles"].to_pylist()]
        there = np.array([v is not None for v in sets])
        for i in range(x.first):
            near = x.like(i)
            if there[i]:
                yield from ((x.cls[i], x.cls[j], False) for j in near[~there[near]])
                near = near[there[near]]
            else:
                yield from ((x.cls[i], x.cls[j], False) for j in near)
                continue
            while len(near):
                now, near = near[:AT_ONCE], near[AT_ONCE:]
                for j in now[linked_to(x, i, now, sets)]:
                    if x.comp[i] != x.comp[j]:
                        x.comp[x.comp == x.comp[j]] = x.comp[i]
                        yield x.cls[i], x.cls[j], True
                near = near[x.comp[near] != x.comp[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_node(batches):
            for x in nodes_of(table):
                if found := list(compare(x)):
                    a, b, sure = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure, pa.bool_())], ["a", "b", "sure"])

    ordered = rows.repartition(F.col("node")).sortWithinPartitions("node", "cls")
    return ordered.mapInArrow(lean(run), "a long, b long, sure boolean")


def sized(paths: DataFrame) -> DataFrame:
    """The rows of nodes of two classes or more, with the node's size and its least class."""
    rows = materialise(paths, "paths")
    counted = rows.groupBy("node").agg(F.count("*").alias("size"), F.min(F.struct("cls", "bits")).alias("least")).where("size > 1")
    found = materialise(rows.join(counted, "node"), "nodes")
    forget(rows)
    return found


def stars(rows: DataFrame, leader: str) -> DataFrame:
    """Pairs of every class and its node's leader whose sketches agree."""
    far = rows.select("cls", "bits", f"{leader}.cls", f"{leader}.bits").toDF("a", "x", "b", "y").where((F.col("a") != F.col("b")) & agree("x", "y"))
    return far.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def mixed_nodes(rows: DataFrame, comp: DataFrame, seed: int) -> DataFrame:
    """The rows of nodes that hold more than one component, with their own component and some leaders of the node."""
    known = rows.select("node", "cls", "bits", "size").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    leaders = [F.min_by(F.struct("cls", "bits", "comp"), F.when(F.col("size") > SMALL, F.xxhash64("cls", F.lit(seed * LEADERS + i)))).alias(f"l{i}") for i in range(LEADERS)]
    mixed = known.groupBy("node").agg(F.min("comp").alias("first"), F.max("comp").alias("last"), *leaders).where("first <> last")
    return materialise(known.join(mixed.select("node", *(f"l{i}" for i in range(LEADERS))), "node"), "mixed")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity (in hundredths)."""
    full = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0
        for batch in small(batches):
            keep = []
            for a, b, ta, tb in zip(*(batch[c].to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                if held > REMEMBERED_BYTES:
                    known.clear()
                    held = 0
                for c, t in ((a, ta), (b, tb)):
                    if c not in known:
                        known[c] = shingle_set(t, width)
                        held += known[c].nbytes
                x, y = known[a], known[b]
                keep.append(100 * (both := len(np.intersect1d(x, y, assume_unique=True))) >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """cls and comp (the least class reachable) of every class with a link: alternating large and small stars."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        seen = Observation()
        stars = small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").where("u <> v").distinct()
        links = materialise(stars.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")), "stars")
        now = seen.get
        if now == before or not now["n"]:
            return links.toDF("cls", "comp")
        before = now


class Texts:
    """Looks up the texts of classes by the id of their first row, without moving the texts of others."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, repeats: bool) -> None:
        self.docs, self.width, self.repeats = text_bytes(docs, F.col("doc_id")), width, repeats
        self.named = classes.select("cls", "hi", "lo", "first_id")

    def of(self, pairs: DataFrame) -> DataFrame:
        """cls and text of all classes in the pairs."""
        return self.some(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())

    def sets(self, wanted: DataFrame) -> DataFrame:
        """cls and the set of each wanted class, null if it is larger than SET_MOST."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                sets = (shingle_set(t, width) for t in batch["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([batch["cls"], pa.array([x.tobytes() if len(x) <= SET_MOST else None for x in sets], pa.binary())], ["cls", "shingles"])

        return self.some(wanted).mapInArrow(lean(run), "cls long, shingles binary")

    def some(self, classes: DataFrame) -> DataFrame:
        """cls and text of the given classes; a class's key tells rows of one id apart."""
        wanted = materialise(classes.join(self.named, "cls"), "wanted")
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
        marks = wanted.select(F.pmod(F.xxhash64("first_id"), F.lit(MARKS)).alias("slot")).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
        table = np.zeros(MARKS // 64, np.int64)
        for r in marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
            table[r.word] = r.bits
        sent = self.docs.sparkSession.sparkContext.broadcast(table)

        @F.pandas_udf("boolean")
        def may_be_wanted(slots: pd.Series) -> pd.Series:
            x = slots.to_numpy()
            return pd.Series((sent.value[x >> 6] >> (x & 63)) & 1 == 1)

        found = wanted.join(self.docs.where(may_be_wanted(slot)), F.col("first_id").eqNullSafe(F.col("doc_id")))
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                keep = [set_key(shingle_set(t, width)) == (hi, lo) for t, hi, lo in zip(batch["text"].to_pylist(), batch["hi"].to_pylist(), batch["lo"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["cls"], batch["text"]], ["cls", "text"]).filter(pa.array(keep, pa.bool_()))

        texts = found.select("cls", "hi", "lo", "text").mapInArrow(lean(run), "cls long, text binary")
        return materialise(texts.dropDuplicates(["cls"]) if self.repeats else texts, "texts")


def linked(docs: DataFrame, classes: DataFrame, width: int, percent: int, repeats: bool) -> DataFrame:
    """cls and comp of the classes that have a confirmed link."""
    texts = Texts(docs, classes, width, repeats)
    signed, checks = classes.select("cls", "sig"), classes.select("cls", "check")
    rows = sized(branch(classes.select("cls", "bits", "sig"), FIRST_LEVELS, TREES))

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs.distinct(), "candidates")
        full = texts.of(pairs)
        found = materialise(confirm(pairs, full, width, percent), "links")
        forget(full)
        return found

    # every node's least class first: it joins most of what belongs together
    links = confirmed(stars(rows, "least"))
    seed = 0
    while True:
        mixed = mixed_nodes(rows, settled(links), seed)
        large = mixed.where(F.col("size") > SMALL)
        doubt = materialise(in_doubt(mixed.where(F.col("size") <= SMALL), checks), "doubt")
        sets = texts.sets(doubt.select("cls").distinct())
        found = materialise(exhaustive(doubt.join(sets, "cls"), percent), "found")
        forget(sets)
        pairs = found.where("not sure").select("a", "b")
        for i in range(LEADERS):
            pairs = pairs.unionByName(stars(large.where(F.col("comp") != F.col(f"l{i}.comp")), f"l{i}"))
        links = links.unionByName(found.where("sure").select("a", "b")).unionByName(confirmed(pairs))
        if large.isEmpty():
            return components(links)
        rows = sized(branch(large.join(signed, "cls"), NEXT_LEVELS))
        seed += 1


def settled(links: DataFrame) -> DataFrame:
    """cls and comp, coarsely: classes of one comp are linked, but a component may still be in several."""
    both = links.select("a", "b").union(links.select("b", "a")).toDF("cls", "other")
    comp = both.groupBy("cls").agg(F.least(F.min("other"), F.col("cls")).alias("comp"))
    for _ in range(2):
        comp = materialise(comp.join(comp.toDF("comp", "further"), "comp").select("cls", F.col("further").alias("comp")), "settled")
    return comp


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the least id reachable) and kept."""
    docs = spread(docs.select("doc_id", "text"))
    signed = materialise(signatures(docs, width), "signatures")
    rows = signed.select("doc_id", "n", "hi", "lo")
    grouped = signed.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("first_id"), F.min("bits").alias("bits"), F.min("sig").alias("sig"), F.min("check").alias("check"))
    classes = materialise(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    repeats = not signed.groupBy("doc_id").count().where("count > 1").isEmpty()
    comp = linked(docs, classes, width, percent, repeats)
    named = classes.select("cls", "hi", "lo", "first_id").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    by_key = named.join(least, "comp").select("hi", "lo", "component_id")
    out = rows.join(by_key, ["hi", "lo"], "left").withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but one row of each component, with their own columns.

    Rows are judged each by id and text, so rows that share an id (or have none) stand apart. The least id stays, any id before
    none, then the least digest of the text; of rows alike in both, the one whose columns come first as JSON. Rows without words
    stay. Columns may have any names.
    """
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), digest.alias("digest"))
    marked = materialise(near_duplicates(docs.select(key.alias("doc_id"), "text"), width, percent), "near-duplicates")
    drop = marked.where(~F.col("kept")).select(F.col("doc_id").alias("key")).distinct()
    repeated = marked.where("kept and n_shingles > 0").groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")
    # the columns travel as one struct, so no name can clash or be taken apart
    left = docs.select(key.alias("key"), row_of(docs, docs.columns).alias("row")).join(drop, "key", "left_anti")
    once = left.join(repeated, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return left.join(repeated, "key", "left_anti").select("row").unionByName(once).select("row.*")
