import random

from pyspark.sql import functions as F

from inkwell.llm import line_dedup


def test_passages_are_deleted_later_and_kept_first(spark, documents):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"intro {i}\n{passage.upper() if i % 2 else passage}\n{i} end" for i in range(30)] + [None, "", "short\nshort\nshort"]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(texts)).collect()}
    assert out[0] == texts[0] and all(out[i] == f"intro {i}\n{i} end" for i in range(1, 30))
    assert out[30] is None and out[31] == "" and out[32] == texts[32]


def test_repeated_rows_null_ids_clashing_names_and_empty(spark, documents):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = documents([passage, "x\n" + passage]).withColumn("N_lines", F.lit("?"))
    twice = docs.unionByName(docs)
    out = line_dedup.dedup_lines(twice)
    assert sorted((r["doc_id"], r["text"], r["n_deleted"]) for r in out.collect()) == [(0, passage, 0)] * 2 + [(1, "x", 1)] * 2
    nulls = docs.where("doc_id = 1").unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    assert {r["text"] for r in line_dedup.dedup_lines(nulls).collect()} == {"x\n" + passage, ""}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def brute_words(docs, min_words):
    """doc: the lines left without each word of a run of min_words words that stands earlier, compared at every word."""
    words = {i: [w for w in (t or "").lower().split()] for i, t in docs.items()}
    first, out = {}, {}
    for i in sorted(docs):
        gone = set()
        for a in range(len(words[i]) - min_words + 1):
            j, c = first.setdefault(tuple(words[i][a : a + min_words]), (i, a))
            if j != i or a >= c + min_words:
                gone |= set(range(a, a + min_words))
        at, left = 0, []
        for raw in (docs[i] or "").split("\n"):
            own = raw.split()
            stay = [w for k, w in enumerate(own) if at + k not in gone]
            if stay or not own and not {at - 1, at} <= gone:
                left.append(stay)
            at += len(own)
        out[i] = left
    return out


def check_words(spark, documents, texts, min_words):
    docs = documents(texts).withColumn("n_deleted", F.lit("?"))
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, min_words=min_words).collect()}
    assert {i: r["n_lines"] for i, r in out.items()} == {i: 0 if t is None else t.count("\n") + 1 for i, t in enumerate(texts)}
    expected = brute_words(dict(enumerate(texts)), min_words)
    assert {i: [x.split() for x in r["text"].split("\n")] if r["text"] is not None else None for i, r in out.items()} == {i: (expected[i] or [[]]) if texts[i] is not None else None for i in out}
    assert all(r["n_deleted"] == len((texts[i] or "").split("\n")) - len(expected[i]) for i, r in out.items() if texts[i] is not None)


def test_passages_in_mid_line_against_brute_force(spark, documents):
    rng = random.Random(12)
    passages = [" ".join(f"q{rng.randrange(3000)}" for _ in range(n)) for n in (24, 25, 50, 51, 77, 130)] + ["the " * 120]
    say = lambda n: " ".join(f"o{rng.randrange(10**6)}" for _ in range(n))
    texts = [None, "", "a\n\nb"]
    for _ in range(50):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages).split()
            a = rng.randrange(max(1, len(p) - 49))
            p = p[a : rng.randint(min(len(p), a + 40), len(p))]
            parts += [say(rng.randint(0, 9)), "".join(w + rng.choice([" ", " ", " ", "  ", "\n", "\n\n"]) for w in p)]
        texts.append(" ".join(parts))
    check_words(spark, documents, texts, 50)
    small = ["".join(rng.choice("abc") + rng.choice([" ", " ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(40)]
    check_words(spark, documents, small, 5)
    check_words(spark, documents, small, 8)
    pool = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 6))) for _ in range(12)] + ["", "  "]
    lines = ["\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {rng.random()} line" for _ in range(rng.randint(0, 14))) for _ in range(60)]
    check_words(spark, documents, lines + lines[:9], 15)


def test_every_shared_run_has_a_shared_fingerprint_and_few_lines_are_selected(spark, documents):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abdenorst") for _ in range(rng.randint(1, 5))) for _ in range(n))
    odd = " ".join(rng.choice(["b", "1", "not", "for"]) for _ in range(50))  # no word breaks a line
    for passage in [say(50) for _ in range(20)] + [odd]:
        texts = [say(rng.randint(0, 40)) + " " + passage + " " + say(rng.randint(0, 40)) for _ in range(2)]
        prints = {i: {r["print"] for r in line_dedup.fingerprints(documents(texts)).where(f"id.id = {i}").collect()} for i in range(2)}
        assert prints[0] & prints[1]
    text = say(20_000)
    line, window, _ = line_dedup.sizes(50)
    n_lines = documents([text]).select(F.size(line_dedup.wrapped(line_dedup._words(F.col("text")), line)).alias("n")).first()["n"]
    n_prints = line_dedup.fingerprints(documents([text])).count()
    assert n_prints < 20_000 / window * 3 and 3 * n_prints < n_lines


def test_other_ids_and_any_column_names(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(f"k{i}", f"{i} {passage} {i}", 1, 2, 3, 4, 5) for i in range(3)]
    df = spark.createDataFrame(rows, ["a.id", "the.text", "row", "doc", "cuts", "left", "at"])
    out = line_dedup.dedup_lines(df, id_col="a.id", text_col="the.text")
    assert out.columns == [*df.columns, "n_lines", "n_deleted"]
    assert sorted(tuple(r)[:7] for r in out.collect()) == [rows[0]] + [(f"k{i}", f"{i} {i}", 1, 2, 3, 4, 5) for i in (1, 2)]


def test_op10_cuts_a_passage_inside_a_line(spark, tmp_path, documents):
    from inkwell.llm import queries

    passage = " ".join(f"p{i}" for i in range(60))
    documents([f"one {passage} two", f"three\nfour {passage} five\nsix"]).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_deleted"]) for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert out == {0: (f"one {passage} two", 1, 0), 1: ("three\nfour five\nsix", 3, 0)}


def test_no_table_of_fingerprints_or_runs_is_written(spark, documents, monkeypatch):
    written = []
    write = line_dedup.materialise
    monkeypatch.setattr(line_dedup, "materialise", lambda df, label: written.append(write(df, label)) or written[-1])
    passage = " ".join(f"p{i}" for i in range(300))
    out = line_dedup.dedup_lines(documents([f"intro {i}\n{passage}\n{i} end" for i in range(20)]))
    assert sorted(r["text"] for r in out.collect())[0] == "intro 0\n" + passage + "\n0 end" and out.where("n_deleted = 1").count() == 19
    assert sum(df.count() for df in written) <= 5 * 20


def shuffled_rows(plan):
    """Rows written by the exchanges of an executed plan."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return shuffled_rows(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return shuffled_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
    return own + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_runs_of_near_copies_are_compared_at_changes_only(spark, documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "materialise", lambda df, label: df)  # all in one plan
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(f"new{k}" if i == 48 * k else w for i, w in enumerate(words)) for k in range(1, 41)]
    out = line_dedup.dedup_lines(documents(texts))
    left = {r["doc_id"]: r["text"].split() for r in out.collect()}
    expected = brute_words(dict(enumerate(texts)), 50)
    assert all(left[i] == [w for x in expected[i] for w in x] for i in left)
    assert shuffled_rows(out._jdf.queryExecution().executedPlan()) < 30_000  # of 78,000 runs
