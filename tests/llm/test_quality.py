import random
from collections import Counter

from pyspark.sql import functions as F

from inkwell.llm import quality


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def slow(text):
    w = words(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    repeated = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = len(w)
    base = {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated)}
    return base | {"base_failed": n < 50 or 100 * len(repeated) > 50 * n}


def texts():
    rng = random.Random(3)
    say = lambda n, k: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n))
    return [None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "x y z x y", "l1\nl1\n \n\nl1 \nl1", "é# ü$ <b>|\x0b\x0cq\r", say(60, 26), say(200, 3), say(3000, 26), "p q r s " * 30, say(500, 2), "a\x1cb c"] + [
        say(n, k) for n in (3, 4, 5, 49, 50, 51, 120) for k in (2, 5, 26)
    ]


def test_base_counts_against_brute_force(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    all_texts = texts()
    out = quality.judge(documents(all_texts).withColumn("N_words", F.lit("x")), labels).collect()
    assert len(out) == len(all_texts)
    for r in out:
        expected = slow(all_texts[r["doc_id"]])
        assert {k: r[k] for k in expected} == expected, (r, all_texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"])  # no labels: every ratio is 0


def test_score_is_the_mean_log_ratio(spark, documents):
    rng = random.Random(9)
    good = [" ".join(rng.choice(["sun", "moon", "star", "sea", "tree", "sky", "rain", "hill"]) for _ in range(80)) for _ in range(200)]
    bad = [" ".join(rng.choice(["###", "$$", "buy"]) + str(rng.randrange(4)) for _ in range(80)) for _ in range(10)]
    docs = documents(good + bad + good[:1])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(200, 0, 0), (5, 1, 0), (None, 1, 0), (201, 1, 1), (202, None, None)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert all(out[i]["kept"] != out[i]["base_failed"] for i in range(200)) and sum(out[i]["kept"] for i in range(200)) > 170 and not any(out[i]["kept"] for i in range(200, 210))
    assert out[210]["score"] == out[0]["score"]
    few = quality.fit(docs, labels, max_trusted=3)
    assert len(few) == quality.BUCKETS and any(few)


def test_empty(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(documents(["a"]).limit(0), labels).count() == 0


def test_few_trusted_documents_still_reject(spark, documents):
    rng = random.Random(9)
    good = [" ".join(rng.choice(["sun", "moon", "star", "sea", "tree", "sky", "rain", "hill"]) for _ in range(80)) for _ in range(30)]
    bad = [" ".join(rng.choice(["###", "$$", "buy"]) + str(rng.randrange(4)) for _ in range(80)) for _ in range(10)]
    docs = documents(good + bad + [good[0].upper()])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(30, 0, 0), (5, 1, 0), (None, 1, 0), (31, 1, 1), (32, None, None)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert all(out[i]["kept"] != out[i]["base_failed"] for i in range(30)) and not any(out[i]["kept"] for i in range(30, 40))
    assert out[40]["score"] == out[0]["score"]
