"""Blocks by expressions over lines against the fold, token by token."""

import random

from inkwell.engine import Engine
from inkwell.operators import blocks, flat
from inkwell.plans.config import Syntax

UNITS = [
    "para x\n", "\n", "\n", "\n", "# h\n", "## h two ##\n", "   # in\n", "#\n", "    code\n", "      code2\n", "    \n", "```\n", "```py x\n", "~~~~\n", "~~~\n", "---\n", "--\n", "***\n", " * * *\n", "===\n", "=\n", "   ==  \n", "___\n",
    "lazy  \n", " nb \n", "#no\n", "  two\n", "-- x\n", "= =\n", "a | b\n",
]
OTHERS = ["> q\n", "- i\n", "1. x\n", "<div>\n", "[a]: /u\n", "\tt\n", "  ```\n", "```a&amp;b\n", "|-|-|\n"]


def written(units, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(units, k=rng.randint(1, 24))).rstrip("\n") + rng.choice(["", "\n"]) for _ in range(n)]


def rows(df):
    return sorted((r["doc_id"], [tuple(t) for t in r["tokens"]]) for r in df.collect())


def test_flat_texts_give_what_the_fold_gives(spark):
    texts = [*written(UNITS[:-1], 400, 3), *written(UNITS + OTHERS, 200, 4), "", "\n", "a", "a\r\n# b\rc"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    engine = Engine()
    assert rows(engine.nested_blocks(docs, by_lines=True)) == rows(engine.nested_blocks(docs))
    known = docs.select("doc_id", flat.parsed(docs["text"], engine.config()).isNotNull().alias("flat")).where("doc_id < 400").where("flat").count()
    assert known == 400


def test_nulls_and_rules_that_are_off(spark):
    docs = spark.createDataFrame([(1, None), (1, "# a"), (None, "b")], "doc_id int, text string")
    assert Engine().nested_blocks(docs, by_lines=True).count() == 2
    off = Engine().disable("heading")
    assert [t["type"] for r in off.nested_blocks(docs.where("doc_id = 1"), by_lines=True).collect() for t in r["tokens"]] == ["paragraph_open", "inline", "paragraph_close"]
    assert docs.select(flat.parsed(docs["text"], off.config()).isNotNull().alias("x")).where("x").count() == 0


def test_flat_documents_need_no_python(spark):
    docs = spark.createDataFrame([(1, "# a\n\nb")], "doc_id int, text string")
    plan = docs.select(flat.parsed(docs["text"], Syntax.preset()).alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert len(blocks.nested(docs).first()["tokens"]) == 6
