import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    """Hit word positions and items found, by comparing every window with every place."""
    words, hit, found = slow_words(text), set(), set()
    for name, item in items:
        seq = slow_words(item)
        for w in [seq[i : i + window] for i in range(max(1, len(seq) - window + 1))] if seq else []:
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(name)
    return hit, found


def fast(text, items, window):
    a = d.Automaton([(n, d.words_of(t)) for n, t in items], window)
    spans, found = a.scan(d.words_of(text))
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    return {i for s, e in spans for i in range(s, e)}, {a.ids[i] for i in found}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("ab ", max_size=14), max_size=5), st.text("abc ", max_size=40), st.integers(1, 4))
def test_automaton_equals_brute_force(items, text, window):
    items = [(str(i), " ".join(t.replace(" ", ""))) if i % 2 else (str(i), t) for i, t in enumerate(items)]
    text = " ".join(text.replace(" ", "")) if len(text) % 2 else text
    assert fast(text, items, window) == brute(text, items, window)


def test_words():
    for text in [None, "", "A-b_c d1é,É中 x\x1fy`z{q}", "\x7f~!09AZaz"]:
        assert [w.decode() for w in d.words_of(text)] == slow_words(text)


def items_and_docs(spark, documents):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(9)) for _ in range(n))
    items = [(1, say(30)), (2, say(12)), (3, "short item"), (4, None), (5, "..."), (2, say(11)), (None, say(15))]
    texts = [say(40) + " " + items[0][1].upper() + ". " + say(40), "A SHORT, item!", items[0][1][:-4] + "x", None, "", say(500), items[1][1] + " and " + items[6][1], items[5][1]]
    return spark.createDataFrame(items, "item_id long, text string"), documents(texts), texts, items


def test_query_level_results_against_brute_force(spark, documents):
    bench, docs, texts, items = items_and_docs(spark, documents)
    names = [("" if i is None else str(i), t) for i, t in items]
    for limit in (d.MAX_WORDS, 20):  # one automaton, and several
        for r in d.find(docs.withColumn("FOUND", F.lit(1)), bench, max_words=limit).collect():
            hit, found = brute(texts[r["doc_id"]], names, 10)
            assert {i for s in r["found"]["spans"] for i in range(s["start"], s["end"])} == hit, r
            assert r["found"]["items"] == sorted(found) and r["found"]["n_words"] == len(slow_words(texts[r["doc_id"]]))


def test_clean_leaves_nothing_and_touches_no_clean_document(spark, documents):
    bench, docs, texts, items = items_and_docs(spark, documents)
    for limit in (d.MAX_WORDS, 20):
        out = {r["doc_id"]: r["text"] for r in d.clean(docs, bench, max_words=limit).collect()}
        assert {3, 4, 5} <= set(out) and out[5] == texts[5] and out[3] is None
        assert 1 not in out and 2 not in out and 6 not in out  # mostly benchmark text
        for i, text in out.items():
            assert not brute(text, [(str(k), t) for k, (_, t) in enumerate(items)], 10)[0]
        assert out[0].startswith(texts[0][:20]) and len(slow_words(out[0])) < len(slow_words(texts[0]))


def test_empty_tables(spark, documents):
    bench, docs, _, _ = items_and_docs(spark, documents)
    assert d.find(docs.limit(0), bench).count() == 0
    assert d.find(docs, bench.limit(0)).where(F.size("found.spans") > 0).count() == 0
    assert d.clean(docs, bench.limit(0)).count() == docs.count()
