import random
import zlib

from pyspark.sql import functions as F

from inkwell.llm import language_id


def texts(seed, n):
    rng = random.Random(seed)
    parts = {"aa": ["the", "ing", "and", "th", "er"], "bb": ["que", "ción", "ado", "ñar", "los"], "cc": ["sch", "ung", "über", "ßen", "keit"]}
    out = []
    for i in range(n):
        lang = list(parts)[i % 3]
        out.append((" ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 200))), lang))
    return out


def test_held_out_accuracy_and_edge_cases(spark, documents):
    rows = texts(1, 240)
    extra = [None, "", "12 34 !?", "the " * 20000]
    docs = documents([t for t, _ in rows] + extra, langs=[lang for _, lang in rows] + [None] * 4).withColumn("Score", F.lit(5))
    network = language_id.fit(docs)
    out = language_id.identify(docs, network).select("doc_id", "lang_pred", "score", language_id.held_out(F.col("doc_id")).alias("held_out")).collect()
    assert len(out) == 244
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    unseen = [r for r in out if r["held_out"] and r["doc_id"] < 240]
    assert len(unseen) > 30 and sum(r["lang_pred"] == rows[r["doc_id"]][1] for r in unseen) / len(unseen) > 0.95
    last = {r["doc_id"]: r for r in out if r["doc_id"] >= 240}
    assert [last[i]["lang_pred"] for i in (240, 241, 242)] == ["und"] * 3 and last[243]["lang_pred"] == "aa"
    again = language_id.identify(docs.repartition(3), language_id.fit(docs.repartition(5)))
    assert {(r["doc_id"], r["lang_pred"], round(r["score"], 5)) for r in out} == {(r["doc_id"], r["lang_pred"], round(r["score"], 5)) for r in again.collect()}


def test_nothing_to_learn_from(spark, documents):
    docs = documents(["words"], langs=[None])
    assert language_id.fit(docs) is None
    assert language_id.identify(docs, None).first()["lang_pred"] == "und"
    assert language_id.identify(docs.limit(0), None).count() == 0


def test_all_bytes_are_in_windows():
    assert language_id.windows("a" * 600).shape == (3, language_id.LENGTH)
    assert (language_id.windows("a" * 600) > 0).sum() == 600


def test_applying_equals_the_plain_sum():
    import numpy as np

    net = language_id.Network(["a", "b"]).compiled()
    x = language_id.windows("Some text, with ü and 12 " * 30)
    pooled = [np.maximum(sum(t[i][x[:, i : i + x.shape[1] - w + 1]] for i in range(w)).max(axis=1), 0) for w, t in net.tables.items()]
    assert np.allclose(net.apply(x), net._softmax(np.concatenate(pooled, axis=1)), atol=1e-5)
