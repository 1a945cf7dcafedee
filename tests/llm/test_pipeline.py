import os
import random

import corpus_pipeline
from inkwell.llm import decontaminate
from inkwell.llm.common import shared_dir


def test_stages_take_effect_and_clean_documents_stay(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}{c}" for a in "bcd" for b in "aeiou" for c in "lm"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = say(25)
    clean = [say(rng.randint(60, 200)) for _ in range(80)]
    copies = [clean[0] + " extra", clean[1], clean[2].capitalize()]
    leaky = [say(100) + " " + item + " " + say(100)]
    junk = [" ".join(f"{w}$$$ #{rng.randrange(9)}" for w in say(80).split()) for _ in range(10)] + ["too short", None, ""]
    texts = clean + copies + leaky + junk
    base = str(tmp_path)
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)] + [(85, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{base}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, base).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        seen.append([r["doc_id"] for r in docs.collect()])
        if k < 4:
            assert docs.columns == columns
    assert set(range(84)) == set(seen[0])
    assert set(seen[1]) == set(range(80)) | {83}
    assert set(seen[2]) == set(seen[1])
    automaton = decontaminate.Automaton([("1", decontaminate.words_of(item))])
    assert not any(automaton.scan(decontaminate.words_of(r["text"]))[1] for r in spark.read.parquet(f"{base}/2").collect())
    assert all(r["n_chars"] == len(r["text"]) for r in spark.read.parquet(f"{base}/2").collect())
    assert set(seen[3]) <= set(seen[2]) and len(seen[3]) > len(seen[2])
    assert sorted(seen[4]) == sorted(seen[3]) and {"shard", "slot"} <= set(docs.columns)
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    out = corpus_pipeline.run(spark, base)
    assert out.count() == len(seen[4])
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before  # the result alone
    assert len(left) == 1 and os.listdir(f"{shared_dir(spark)}/{left.pop()}".removeprefix("file:")) == ["4"]
