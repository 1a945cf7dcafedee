"""Written cases, an input and its HTML each: what the engine gave when it agreed with the public examples of the specifications."""

import os

import pytest
from pyspark.sql import functions as F

from inkwell.engine import Engine
from inkwell.sources import files

FOLDER = os.path.join(os.path.dirname(__file__), "cases")
ENGINES = {"commonmark": Engine("commonmark"), "gfm": Engine("gfm-like2"), "typographer": Engine("default", {"typographer": True})}


@pytest.mark.parametrize(("name", "least"), [("commonmark", 300), ("gfm", 60), ("typographer", 30)])
def test_cases(spark, name, least):
    cases = files.read_cases(spark, os.path.join(FOLDER, f"{name}.md")).select(F.struct("line", "title", "input", "expected").alias("doc_id"), F.col("input").alias("text"))
    rows = ENGINES[name].render(cases).select("doc_id.*", "html").collect()
    wrong = [(r["line"], r["title"], r["input"], r["expected"], r["html"]) for r in rows if r["html"] != r["expected"]]
    assert len(rows) >= least and wrong == []
