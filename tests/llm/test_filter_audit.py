"""The filter audit against a plain walk of every document through every order."""

import re
from itertools import permutations

from evidara.llm import filter_audit


def plain(docs, labels):
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t, _ in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for (i, t, _), w in zip(docs, words, strict=True):
        t = t or ""
        f = {"A"} if len(w) < 50 else set()
        f |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        f |= {"D"} if re.search("[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else set()
        fails.append(f)
    out, shapley = [], {}
    for part in {s or "" for _, _, s in docs}:
        mine = [(f, d[0]) for f, d in zip(fails, docs, strict=True) if (d[2] or "") == part]
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                removed = [i for f, i in mine if not f & before and x in f]
                row = (sum(not f & before and x not in f for f, _ in mine), len(removed), sum(bool(f & before) and x in f for f, _ in mine), sum(f == {x} for f, _ in mine), sum(i in good for i in removed), sum(i in toxic for i in removed))
                out.append((part, "".join(order), k + 1, *row))
                shapley[part, x] = shapley.get((part, x), 0) + len(removed)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_every_order(spark):
    long = " ".join(f"word{k}" for k in range(60))
    texts = [long, long, long + " #", long.upper(), "a " * 80, "short", None, "", long + " x", "short", "A|B", "日本 " * 51]
    docs = [(i, t, ["s", "t", None, ""][i % 4]) for i, t in enumerate(texts)] + [(3, long, "s"), (0, long, "t"), (None, long, "s"), (None, long, "u"), (None, "short", None), (50, long, "u"), (50, long, "u")]
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (2, None, 1), (9, 1, 1), (50, 1, 1), (None, 1, 1), (77, 1, 1)]
    frame = spark.createDataFrame([(*d, 0.5, "x") for d in docs], "doc_id long, text string, source string, fails double, part string")
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(tuple(r) for r in got) == plain(docs, labels)


def test_no_rows(spark, no_docs):
    assert filter_audit.audit(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_edges():
    assert sum(not s >> f & 1 for f in range(5) for s in range(32)) == 80
