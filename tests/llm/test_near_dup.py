"""Near-duplicates against all pairs."""

import os
import random
from itertools import combinations

import numpy as np
import pytest

from evidara.llm import near_dup
from evidara.llm.common import shared_dir


def brute(rows, width, percent=80):
    """(id, set size, component) of each row by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            group[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(i)] = min(ids.get(top(i), d), d)
    return sorted((str(d), len(sets[i]), str(ids.get(top(i)))) for i, (d, _) in enumerate(rows))


def families(seed, groups, copies, edits):
    r = random.Random(seed)
    words = ["the", "of", "and"] * 10 + [f"w{i}" for i in range(200)]
    rows = []
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.randint(5, 120))]
        for _ in range(r.randint(1, copies)):
            own = [r.choice(words) if r.random() < r.choice(edits) else w for w in base]
            rows.append(" ".join(own) + r.choice(["", " ", "\n"]))
    r.shuffle(rows)
    return list(enumerate(rows))


def found(spark, rows, width):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dup.near_duplicates(df, width).collect())


@pytest.mark.parametrize(("width", "seed"), [(2, 1), (5, 2)])
def test_all_pairs(spark, width, seed):
    rows = families(seed, 60, 12, [0.0, 0.02, 0.05, 0.1])
    assert found(spark, rows, width) == brute(rows, width)


def test_one_large_family(spark, monkeypatch):
    """Nodes far above the exhaustive size, with links only here and there."""
    monkeypatch.setattr(near_dup, "SMALL", 24)
    rows = families(3, 1, 1, [0.0])
    r = random.Random(5)
    base = [f"w{r.randint(0, 500)}" for _ in range(100)]
    rows = [(i, " ".join(w if r.random() > 0.05 else f"x{r.randint(0, 999)}" for w in base)) for i in range(70)] + [(200 + i, t) for i, t in rows]
    assert found(spark, rows, 2) == brute(rows, 2)


def test_groups_that_meet_in_several_nodes_are_compared_once(spark):
    """What is alike only by pairs comes apart, and each pair leaves once, from however many nodes."""
    sketch = np.random.default_rng(4).integers(0, 256, (3, near_dup.CHECKS // 8)).astype(np.uint8)
    of = {1: sketch[0], 2: sketch[0], 3: sketch[1], 4: sketch[1], 5: sketch[2]}
    nodes = {10: [1, 2, 3, 4], 11: [1, 2], 12: [3, 4, 5], 13: [1, 2, 5], 14: [1, 3, 5]}
    rows = [(n, c, int.from_bytes(of[c][:8].tobytes(), "little", signed=True), c) for n, cs in nodes.items() for c in cs]
    small = spark.createDataFrame(rows, "node long, cls long, bits long, comp long")
    checks = spark.createDataFrame([(c, x.tobytes()) for c, x in of.items()], "cls long, check binary")
    got = {}
    for r in near_dup.in_doubt(small, checks).collect():
        got.setdefault(r.node, []).append(r.cls)
    assert sorted(map(sorted, got.values())) == [[1, 2], [3, 4]]


def test_tables_that_nothing_reads_any_more_are_deleted(spark):
    rows = families(6, 20, 8, [0.0, 0.02, 0.1])

    def kept():
        folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
        return {f for f in os.listdir(folder) if f.startswith(("paths-", "texts-"))}

    before = kept()
    assert found(spark, rows, 2) == brute(rows, 2)
    assert kept() == before


def test_odd_input(spark, odd_docs, no_docs):
    assert near_dup.near_duplicates(no_docs).count() == 0
    assert near_dup.keep_one(no_docs).count() == 0
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(spark, rows, 2) == brute(rows, 2)
    kept = near_dup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in [0, 1, 2, 3, *range(5, 13), None])


def test_same_id_with_other_texts(spark):
    rows = [(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (3, "a b c d"), (3, "a b c d")]
    assert found(spark, rows, 2) == brute(rows, 2)


def test_keep_one_judges_rows(spark):
    a, b, c, d = "one two three four five six", "red green blue white black pink", "up down left right in out", "sun moon star sky sea land"

    def kept(rows):
        return sorted(((r.doc_id, r.text) for r in near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)

    # a null id in a group does not take clean rows of null id along
    assert kept([(1, a), (None, a), (None, b), (None, c)]) == sorted([(1, a), (None, b), (None, c)], key=str)
    # the text that shares its id with a dropped copy keeps its representative
    assert kept([(0, b), (1, a), (1, b), (2, d)]) == [(0, b), (1, a), (2, d)]
    # exact copies without ids leave one
    assert kept([(None, a), (None, a), (None, a + " "), (None, d)])[-1] == (None, d) and len(kept([(None, a), (None, a), (None, a + " "), (None, d)])) == 2


def test_branching_keeps_similar_pairs():
    """Twelve trees find pairs of similarity 0.8 and beyond."""
    r, lost = np.random.default_rng(0), 0
    for _ in range(400):
        a = r.integers(0, 2**63, 90).astype(np.uint64)
        b = np.concatenate([a[:80], r.integers(0, 2**63, 10).astype(np.uint64)])
        sig = np.stack([near_dup.minwise(np.unique(a)), near_dup.minwise(np.unique(b))])[:, : near_dup.SIZE]
        nodes = np.tile(near_dup.mix(np.arange(1, near_dup.TREES + 1, dtype=np.uint64)), 2)
        owner = np.repeat([0, 1], near_dup.TREES)
        for _ in range(near_dup.FIRST_LEVELS):
            nodes, at = near_dup.step(nodes, sig[owner])
            owner = owner[at]
        lost += not set(nodes[owner == 0]) & set(nodes[owner == 1])
    assert lost == 0
