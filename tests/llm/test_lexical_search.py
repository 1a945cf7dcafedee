"""Ranked lexical search against scores of every pair."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import lexical_search
from inkwell.llm.common import materialise

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c in counted:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def found(spark, docs, items, k=10, kind="long"):
    d = spark.createDataFrame(docs, f"doc_id {kind}, text string, n long" if len(docs[0]) > 2 else f"doc_id {kind}, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    rows = lexical_search.search(materialise(lexical_search.index(d), "index"), q, k).collect()
    return [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)] + ["É", "naïve", "A1"]
    text = lambda n: rng.choice([" ", ", ", "\n", "_"]).join(rng.choices(words, k=n))
    docs = [(i, text(rng.randint(1, 300))) for i in range(700)]
    docs += [(700 + i, "w1 w2 w3 the same text") for i in range(40)]  # ties
    docs += [(13, text(20)), (13, None), (None, "w5 w6"), (901, ""), (902, " .,! "), (903, "w7 " * 400)]
    return docs, [(j, text(12)) for j in range(12)] + [(20, "w1 w2 the same"), (21, None), (22, ""), (23, "absent"), (24, "w9"), (24, "w10"), (25, "W7 w7")]


def test_all_pairs(spark, corpus):
    docs, items = corpus
    rows = found(spark, docs, items)
    assert sorted(rows, key=str) == sorted(brute(docs, items, 10), key=str)
    assert [r[2] for r in sorted(rows) if r[0] == 20] == list(range(700, 710))  # the smallest ids of forty equal scores
    assert {r[0] for r in rows}.isdisjoint({21, 22, 23})


def test_blocks_of_items(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 30)
    assert sorted(found(spark, docs, items, 3), key=str) == sorted(brute(docs, items, 3), key=str)


def test_string_ids_and_clashing_columns(spark):
    docs = [("b", "x y", 5), ("a", "x y", 6), ("c", "z", 7)]
    assert sorted(found(spark, docs, [(1, "x")], kind="string"))[0][2:] == ("a", found(spark, docs, [(1, "x")], kind="string")[0][3])


def test_empty_tables(spark):
    assert found(spark, [(1, None)], [(1, "x")]) == [] and found(spark, [(1, "x")], [(1, None)]) == []


def test_a_sketch_bounds_every_impact(spark, corpus):
    docs = [c for _, t in corpus[0] if (c := lexical_search.terms_of((t or "").encode()))]
    for counts in docs[:200]:
        names = list(counts)
        rows = np.frombuffer(lexical_search._sketch(names, np.array(list(counts.values()))), np.uint8).reshape(2, -1)
        at = lexical_search.coordinates(names) & (rows.shape[1] - 1)
        for k, name in enumerate(names):
            assert min(rows[0][at[0][k]], rows[1][at[1][k]]) >= min(counts[name], lexical_search.FULL)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Ab cd, é_x 12 " * 50
    whole = lexical_search.terms_of(text.encode())
    monkeypatch.setattr(lexical_search, "_CHUNK", 7)
    assert lexical_search.terms_of(text.encode()) == whole == Counter(t.encode() for t in terms(text))
