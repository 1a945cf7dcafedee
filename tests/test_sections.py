"""Long documents in sections against the same documents parsed whole."""

import random
import time

import pytest
from pyspark.sql import functions as F

from inkwell.engine import Engine
from inkwell.operators import sections

UNITS = [
    "para [r] x\n", "\n", "\n", "\n", "# h\n", "> q\n", "> ```\n", "- i\n", "  - j\n", "  c\n", "    code\n", "```\n", "```py\n", "~~~~\n", "~~~\n", "[r]: /u%d\n", "[s]:\n", "/v 'a\n", "b'\n", "|a|b|\n|-|-|\n", "---\n", "***\n", "===\n", "1. x\n",
    "2) y\n", "\tt\n", "![s] [S][] text\n", "lazy\n", "  ```\n", "<div>\n", "<!-- c\n", "-->\n", "[o\\]]: /o\n", "> [q]: /q\n", "[o\\]] [q]\n",
]


def written(n, seed):
    rng = random.Random(seed)
    return ["".join(u % rng.randint(0, 9) if "%" in u else u for u in rng.choices(UNITS, k=rng.randint(5, 70))) for _ in range(n)]


@pytest.mark.parametrize("preset", ["commonmark", "gfm-like2"])
def test_sections_give_the_whole(spark, preset):
    """Cut wherever the line classes allow it: blocks, lines and HTML are those of the whole text, with definitions from everywhere."""
    texts = [*written(400, 8), "", None, "one line", "# a\n\n" * 30]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    engine = Engine(preset)
    said = F.transform("tokens", lambda t: F.concat_ws("|", t["type"], t["line_begin"], t["line_end"], t["content"], t["hidden"]))
    whole = {r["doc_id"]: (r["said"], r["html"]) for r in engine.nested(docs).select("doc_id", said.alias("said")).join(engine.render(docs), "doc_id").collect()}
    parts: dict[int, list] = {}
    for r in engine.sections(docs, least=1).select("doc_id", "section", said.alias("said")).join(engine.render_sections(docs, least=1), ["doc_id", "section"]).orderBy("doc_id", "section").collect():
        parts.setdefault(r["doc_id"], []).append((r["said"], r["html"]))
    joined = {i: ([x for said, _ in p for x in said], "".join(html for _, html in p)) for i, p in parts.items()}
    assert joined == whole
    assert sum(map(len, parts.values())) > 1.3 * len(parts) and len(parts[len(texts) - 1]) == 30


def test_only_long_documents_are_cut(spark):
    docs = spark.createDataFrame([(1, "a\n\nb\n\n" * 100), (1, "a [x]\n\n" * 3000 + "[x]: /u"), (None, "c\n\n" * 3000)], "doc_id long, text string")
    parts = Engine().sections(docs)
    rows = parts.select("doc_id", "section", "first_line", F.aggregate(F.filter(F.flatten("children"), lambda c: c["type"] == "link_open"), F.lit(0), lambda n, c: n + 1).alias("links")).collect()
    assert sorted(r["section"] for r in rows if r["doc_id"] == 1) == [0, 0, 1, 2, 3, 4, 5] and sum(r["links"] for r in rows) == 3000
    assert [r["first_line"] for r in sorted(rows, key=str) if r["doc_id"] is None] == [0, 1000, 2000, 3000, 4000, 5000]


def test_a_short_rest_is_no_section(spark):
    docs = spark.createDataFrame([(n, "a\n\n" * n + "[x]: /u") for n in (8, 9, 10, 12)], "doc_id int, text string")
    parts = Engine().sections(docs, least=8)
    assert [(r["doc_id"], r["first_line"]) for r in parts.orderBy("doc_id", "section").collect()] == [(8, 0), (8, 8), (9, 0), (9, 8), (10, 0), (10, 8), (12, 0), (12, 8), (12, 16)]


def test_nothing_is_cut_inside_a_fence(spark):
    docs = spark.createDataFrame([(1, "a\n\n```\n\nb\n\nc\n\n```\n\nd\n\n~~~~\n\n~~~\n\ne")], "doc_id long, text string")
    assert [r["first_line"] for r in Engine().sections(docs, least=1).orderBy("section").collect()] == [0, 2, 10, 12]
    off = Engine().disable("fence")
    assert off.sections(docs, least=1).count() > 4


def test_labels_are_found_however_they_are_written(spark):
    """Broken over the lines of quotes and lists, escaped, in cells, in other case: a section gets the definitions that it names."""
    uses = ["> [two\n> words]", "> [m\n>     > n]", "> > [k\nl]", "- [li\n  st]", "[b\\\\]", "[o\\] \\[p]", "|a [x\\|y]|\n|-|\n|[x\\|y]|", "![i][SS]", "[t][q\tr]", "[a`\\`]", "[in [side] out][two words]", "[a > b][]"]
    labels = ["two words", "m > n", "K L", "li st", "b\\\\", "o\\] \\[p", "x|y", "x\\|y", "ß", "Q R", "a`\\`", "side", "a > b"]
    text = "\n\n".join([*uses, *(f"[{label}]: /{i}" for i, label in enumerate(labels)), "end"])
    docs = spark.createDataFrame([(1, text), (None, text)], "doc_id int, text string")
    engine = Engine("gfm-like2")
    parts = engine.render_sections(docs, least=1).orderBy("section").collect()
    whole = engine.render(docs).first()["html"]
    assert len(parts) > 2 * len(uses) and all("".join(p["html"] for p in parts if p["doc_id"] == i) == whole for i in (1, None))
    assert whole.count("<a href") + whole.count("<img") >= len(uses)


def test_the_work_grows_with_the_lines(spark, monkeypatch):
    """A document of 25,000 lines with a fence and a definition for every ten: it is cut in one go through the lines, and a section gets the definitions that it names, not all."""
    sources = []
    parsed = sections.inlines.parsed
    monkeypatch.setattr(sections.inlines, "parsed", lambda source, *args, **options: sources.append(source) or parsed(source, *args, **options))
    n = 2500
    text = "".join(f"# h {i}\n\nsee [the {i}]\n\n```\n\n# no {i}\n```\n\n" for i in range(n)) + "\n" + "\n".join(f"[the {i}]: /c/{i}" for i in range(n))
    began = time.perf_counter()
    parts = Engine().sections(spark.createDataFrame([(1, text)], "doc_id int, text string"), least=40)
    hrefs = F.transform(F.filter(F.flatten("children"), lambda c: c["type"] == "link_open"), lambda c: F.get(c["attrs"], 0)["value"])
    found = [r for r in parts.select("section", hrefs.alias("hrefs")).orderBy("section").collect()]
    took = time.perf_counter() - began
    assert [h for r in found for h in r["hrefs"]] == [f"/c/{i}" for i in range(n)] and len(found) > 400
    assert sources[0].agg(F.sum(F.size("common"))).first()[0] <= 2 * n + len(found)
    assert took < 60


def test_a_text_of_many_documents_is_dealt_out(spark, monkeypatch):
    """Its sections are not put together by text: they come from several tasks, each with its definitions."""
    monkeypatch.setattr(sections, "SALTS", 4)
    text = "a [x]\n\nb [y]\n\n[x]: /x\n[y]: /y\n\nend"
    docs = spark.createDataFrame([(None if i % 5 == 0 else i, text) for i in range(60)] + [(60, "c [x]\n\n[x]: /z")], "doc_id int, text string").repartition(4)
    parts = Engine().sections(docs, least=1)
    hrefs = F.transform(F.filter(F.flatten("children"), lambda c: c["type"] == "link_open"), lambda c: F.get(c["attrs"], 0)["value"])
    found = [(r["doc_id"], r["section"], *r["hrefs"]) for r in parts.select("doc_id", "section", hrefs.alias("hrefs")).collect()]
    each = [(0, "/x"), (1, "/y"), (2,), (3,)]
    assert sorted(found, key=str) == sorted([(None if i % 5 == 0 else i, *x) for i in range(60) for x in each] + [(60, 0, "/z"), (60, 1)], key=str)
    assert "spark_partition_id" in parts._jdf.queryExecution().toString().lower()
