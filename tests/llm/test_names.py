"""Every operator and stage with extra columns of all internal names and of dotted names, with string ids and repeated ids."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import decontaminate, html_extract, language_id, lexical_search, line_dedup, mixing, near_copies, nearest, quality, sharding, simhash, token_counts, url_filter, whitening
from inkwell.llm.common import materialise

#: Names that operators use inside, and names that need quoting.
NAMES = (
    "row id digest fp node root first key n cut cuts words todo done found _found _found_0 _done _words _cut _id _text _spans _lang _digest _n plan repeats extra gap s cell rank block at ends left doc print place near run1 "
    "kept score n_words trusted word toxic bad good gram bands held main fit hot label window"
).split() + ["a.b", "the name", "x`y"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(str(i), 1, int(i == 3)) for i in range(6)], "doc_id string, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    passage = " ".join(f"w{i} and" for i in range(40))
    texts = [passage, passage, "other words " * 40, None, "", f"{passage} with a tail", "short"]
    rows = [(f"k{i % 5}", t, "en", f"s{i % 2}", len(t or ""), *[f"{i}:{k}" for k in range(len(NAMES))]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id string", "text string", "lang string", "source string", "n_chars int", *[f"`{n.replace('`', '``')}` string" for n in NAMES]]))


def same_columns(docs, out, changed=("text",)):
    """The input's columns come out in order and with their values, row by row (the first extra column names the row)."""
    assert out.columns[: len(docs.columns)] == docs.columns
    keep = [i for i, c in enumerate(docs.columns) if c not in changed]
    given = {r[5]: tuple(r[i] for i in keep) for r in docs.collect()}
    rows = out.collect()
    assert all(given[r[5]] == tuple(r[i] for i in keep) for r in rows)
    return [r[5].split(":")[0] for r in rows]


EVERY = [str(i) for i in range(7)]


def test_operators_keep_every_column(spark, docs, labels, tmp_path):
    items = spark.createDataFrame([("i", " ".join(f"w{i} and" for i in range(3, 12)), 1)], ["item.id", "text", "row"])
    named = {"item_id": "item.id", "item_text": "text"}
    own = docs.drop("kept", "score", "n_words")
    assert sorted(same_columns(own, quality.judge(own, labels))) == EVERY
    bare = docs.drop("found")
    assert sorted(same_columns(bare, decontaminate.find(bare, items, **named))) == EVERY
    assert sorted(same_columns(docs, decontaminate.clean(docs, items, **named))) == EVERY
    assert sorted(same_columns(docs, decontaminate.clean(docs, items.unionByName(items.withColumn("text", F.lit("x y z"))), max_words=20, **named))) == EVERY
    assert sorted(same_columns(docs, line_dedup.dedup_lines(docs))) == EVERY
    assert set(same_columns(docs, mixing.mix(docs))) <= set(EVERY)
    assert sorted(same_columns(docs, sharding.shard(docs, 3))) == EVERY
    assert sorted(same_columns(own, language_id.identify(own, language_id.fit(own)))) == EVERY
    import public_tokenizers

    assert sorted(same_columns(docs, token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")))) == EVERY
    assert sorted(same_columns(docs, html_extract.extract(docs, html_col="text", out_col="clear"))) == EVERY
    assert sorted(same_columns(own, url_filter.judge(own.withColumn("url", F.lit("http://a.b/c"))).drop("url"))) == EVERY
    assert simhash.membership(docs).count() == 7


def test_distinct_texts_of_one_id_stay(docs):
    # ids k0 to k4, k0, k1: rows 0 and 1 are copies, 3 and 4 both wordless, 5 and 6 repeat the ids of 0 and 1 with other texts.
    assert sorted(same_columns(docs, simhash.keep_one(docs))) in (["0", "2", "3", "5", "6"], ["0", "2", "3", "6"])
    kept = sorted(same_columns(docs, near_copies.keep_one(docs)))
    assert {"2", "3", "6"} <= set(kept) and len(kept) == 4 and len({"0", "5"} & set(kept)) == 1  # 0, 1 and 5 are near copies


def test_stages_keep_every_column(spark, docs, labels, tmp_path):
    base = str(tmp_path)
    labels.write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, base)
        assert set(same_columns(docs, out, ("text", "n_chars"))) <= set(EVERY), name
        assert stage(spark, docs.limit(0), base).count() == 0, name


def test_searches_and_whitening_read_their_columns_alone(spark, docs):
    items = spark.createDataFrame([("i", "other words", 1)], ["item.id", "the text", "terms"])
    found = lexical_search.search(materialise(lexical_search.index(docs), "index"), items, id_col="item.id", text_col="the text").collect()
    assert [(r["item_id"], r["doc_id"]) for r in found] == [("i", "k2")]
    rows = [(f"v{k}", [float(k), float(k * k % 7), 1.0], *[f"{k}:{n}" for n in NAMES]) for k in range(9)]
    vectors = spark.createDataFrame(rows, ", ".join(["`vec.id` string", "`the vector` array<double>", *[f"`{n.replace('`', '``')}` string" for n in NAMES]]))
    named = {"id_col": "vec.id", "vec_col": "the vector"}
    assert {r["component"] for r in whitening.whiten(vectors, **named).collect()} == {1, 2}
    usable = nearest.points(vectors, **named)
    near = nearest.search(materialise(nearest.index(usable), "blocks"), usable.where("vec_id = 'v3'"), 2).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(near)] == [("v3", 1), ("v3", 2)] and "v3" not in {r["vec_id"] for r in near}
