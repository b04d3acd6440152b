"""Substring deduplication against a plain reading of every window."""

import random

import pytest

from evidara.llm import repeats


def plain(rows):
    """(id, text) -> (words kept, words removed) by a dictionary of all windows."""
    words = [(repeats.NO_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for a in range(len(w) - 12):
            g = tuple(w[a : a + 13])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = {j for a in range(len(w) - 12) if first[tuple(w[a : a + 13])] < i for j in range(a, a + 13)}
        out.append((b" ".join(x for j, x in enumerate(w) if j not in gone).decode(), len(gone)))
    return out


def shown(rows):
    return sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in rows)


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return shown((r.row.doc_id, r.text, r.n_removed) for r in repeats.remove_repeats(docs).collect())


def expected(rows):
    return shown((i, *x) for (i, _), x in zip(rows, plain(rows), strict=True))


def some_rows(seed, n=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["é", "日本", "ß"]
    passages = [[r.choice(words) for _ in range(r.randint(13, 60))] for _ in range(6)]
    rows = []
    for i in r.sample(range(1000), n):
        w = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randint(0, len(p) - 13)
            w += p[a : a + r.randint(12, 40)] if r.random() < 0.7 else [r.choice(words) for _ in range(r.randint(1, 40))]
        rows.append((i, r.choice([" ", "\n", " \t "]).join(w)))
    return rows + [(rows[0][0], rows[1][1]), rows[2], rows[2], (None, rows[3][1]), (None, rows[3][1]), (5000, None), (5001, ""), (5002, rows[4][1] * 2), (5003, "a " * 300), (5004, "a " * 13), (5005, "a " * 12)]


@pytest.mark.parametrize("seed", range(3))
def test_every_window(spark, seed):
    rows = some_rows(seed)
    assert found(spark, rows) == expected(rows)


@pytest.mark.parametrize("least", [2, 6])
def test_hot_passages(spark, monkeypatch, least):
    """With a low bound most anchors are hot: by the automaton that all tasks have, and window by window."""
    monkeypatch.setattr(repeats, "LEAST_HOT", least)
    rows = some_rows(7, 80)
    assert found(spark, rows) == expected(rows)


def test_full_map(spark, monkeypatch):
    """A map that says perhaps of everything changes nothing."""
    monkeypatch.setattr(repeats, "MOST_BITS", 1 << 15)
    monkeypatch.setattr(repeats.BitMap, "may_hold", lambda self, names: names == names)
    rows = some_rows(11)
    assert found(spark, rows) == expected(rows)


def test_small_batches(spark, monkeypatch):
    for name, value in (("TOGETHER", 50), ("HELD", 5), ("SHARD_BYTES", 200)):
        monkeypatch.setattr(repeats, name, value)
    rows = some_rows(13)
    assert found(spark, rows) == expected(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumnRenamed("score", "words").withColumn("a.b", odd_docs.doc_id)
    got = repeats.remove_repeats(docs).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert shown((r.row.doc_id, r.text, r.n_removed) for r in got) == expected(rows)
    assert set(got[0].row.asDict()) == {"doc_id", "words", "row", "a.b"}
    assert repeats.remove_repeats(no_docs).collect() == []


def test_window_names():
    import numpy as np

    codes = np.array([1, 2] * 20 + [3] + [1, 2] * 10)
    names = repeats.window_names(codes)
    spelled = [tuple(codes[i : i + 13]) for i in range(len(codes) - 12)]
    assert len(set(names)) == len(set(spelled)) == len(set(zip(names, spelled, strict=True)))
