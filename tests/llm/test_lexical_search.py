"""Ranked search against brute force, on odd input and on trees that must be pruned."""

import math
import random
import re
from collections import Counter

import numpy as np

from statuteflow.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 75 + 25 * bag.total() * n_docs // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def answer(spark, docs, items, k):
    d = spark.createDataFrame([(i, t, 1.0, "x") for i, t in docs], "doc_id long, text string, score double, item string").repartition(3)
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int")
    return sorted([tuple(r) for r in L.search(d, q, k).collect()], key=repr)


def test_results_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "LEAF", 4)
    monkeypatch.setattr(L, "BLOCK_BYTES", 900)
    rng = random.Random(3)
    words = [f"W{int(rng.paretovariate(0.7))}" for _ in range(9_000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(300)]
    docs += [(1_000 + i, docs[5][1]) for i in range(60)] + [docs[7], docs[7]]  # copies: equal scores by doc_id; repeated rows
    docs += [(2_000, None), (2_001, ""), (2_002, "--- ... ''"), (None, docs[9][1]), (2_003, "w1 " * 40_000), (2_004, "é日本x_W2/w2.W3"), (2_005, "x" * 100_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(40)]
    items += [(100, docs[5][1]), (101, None), (102, "nowhere"), (103, "日本x É é日本x"), (None, docs[9][1]), (104, "w1 w1 W1")]
    for k in (20, 1):
        assert answer(spark, docs, items, k) == brute(docs, items, k)


def test_empty_tables(spark):
    assert answer(spark, [], [(1, "a")], 20) == [] and answer(spark, [(1, "a")], [], 20) == [] and answer(spark, [(1, None)], [(1, None)], 20) == []


def test_subtrees_below_the_bound_are_not_scored():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(np.arange(1, 30), 4, replace=False)) if i % 10 else np.array([0, 40 + i // 500]) for i in range(4_000)]
    ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    tree = L.Tree(ptr, np.concatenate(rows), np.ones(ptr[-1], dtype=np.int32), np.full(len(rows), 100), 60)
    state = L.Search([(np.array([0, 41]), np.array([1, 1]))], np.full(60, 1_000), 5)
    state.ask(tree, list(range(len(rows))))
    assert [i for *_, i in state.best[0]] == [500, 510, 520, 530, 540] and state.visited <= 3
