from fractions import Fraction

from pyspark.sql import functions as F

from inkwell.llm import mixing


def test_water_fill_clamps_and_redistributes():
    assert mixing.water_fill([10, 100, 100], [5, 2, 1], Fraction(315), 2) == [20, Fraction(590, 3), Fraction(295, 3)]
    assert mixing.water_fill([10, 90, 100], [5, 2, 1], Fraction(300), 2) == [20, 180, 100]  # the second is above only after the first is clamped


def test_water_fill_is_proportional_where_nothing_is_capped():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], Fraction(80), 2) == [50, 20, 10]
    assert mixing.water_fill([0, 0], [5, 2], Fraction(0), 2) == [0, 0]
    assert mixing.water_fill([], [], Fraction(0), 2) == []


def brute(rows, seed):
    """(source, text, id) rows to id: repeats, by sorting each source's digests."""
    import hashlib
    import zlib

    names = sorted({r[0] for r in rows}, key=lambda s: (s is None, s or ""))
    size = lambda t: len((t or "").encode().split())
    sizes = [sum(size(r[1]) for r in rows if r[0] == s) for s in names]
    targets = mixing.water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], Fraction(3, 2) * sum(sizes), 2)
    out = {}
    for s, n, t in zip(names, sizes, targets):
        whole = int(t / n) if n else 0
        rest = float(t - whole * n)
        key = lambda r: hashlib.md5(f"{seed}|{r[2]}|{zlib.crc32((r[1] or '').encode())}".encode()).hexdigest()
        mine = sorted((key(r), size(r[1]), r[2]) for r in rows if r[0] == s and size(r[1]))
        for r in rows:
            if r[0] == s:
                out[r[2]] = whole
        if rest > 0:
            gap, k = rest, 0
            while k < len(mine) and mine[k][1] <= gap:
                gap -= mine[k][1]
                out[mine[k][2]] += 1
                k += 1
            later = mine[k:]
            for _ in range(mixing.FILL):
                first = {}
                for d in later:
                    if d[1] <= gap:
                        first.setdefault(d[1].bit_length(), d)
                for d in sorted(first.values(), key=lambda d: (d[1], d[0]), reverse=True):
                    if d[1] <= gap:
                        gap -= d[1]
                        out[d[2]] += 1
                        later.remove(d)
            near = min((d for d in later if d[1] < 2 * gap), key=lambda d: (abs(d[1] - gap), d[0]), default=None)
            if near:
                out[near[2]] += 1
    return out, dict(zip(names, map(float, targets)))


def test_against_brute_force_with_nulls_and_skew(spark, documents):
    texts = [" ".join(["w"] * (i % 13)) if i % 11 else None for i in range(300)]
    sources = [None if i % 17 == 0 else f"s{i % 5}" if i % 3 else "hot" for i in range(300)]
    out = mixing.repetitions(documents(texts, sources)).collect()
    expected, targets = brute([(s, t, i) for i, (s, t) in enumerate(zip(sources, texts))], 42)
    assert len(out) == 300
    for r in out:
        assert r["target"] == targets[r["source"]]
        assert r["repeats"] <= 2
        if r["size"]:
            assert r["repeats"] == expected[r["doc_id"]], r
    for s, t in targets.items():
        taken = sum(r["size"] * r["repeats"] for r in out if r["source"] == s)
        assert abs(taken - t) <= 1  # there are documents of every size from 1 to 12


def test_mix_repeats_rows_and_keeps_the_columns(spark, documents):
    df = documents(["a b c"] * 30, ["x"] * 20 + ["y"] * 10).withColumn("Size", F.lit(1))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    rows = [r["doc_id"] for r in mixed.collect()]
    assert sorted(rows) == sorted(r["doc_id"] for r in mixing.mix(df.repartition(3)).collect())
    assert max(rows.count(i) for i in range(30)) <= 2 and len(rows) == 45


def test_empty_and_wordless(spark, documents):
    assert mixing.repetitions(documents(["a"]).limit(0)).count() == 0
    assert [r["size"] for r in mixing.repetitions(documents([None, "", " \t"])).collect()] == [0, 0, 0]


def test_any_column_names_string_ids_and_repeated_ids(spark):
    names = ["the.id", "the.text", "the.source", "plan", "cut", "extra", "id", "text", "s", "source", "row", "n"]
    df = spark.createDataFrame([(f"k{i // 2}", "a b c " * (i % 5), f"s{i % 3}", *[1] * 9) for i in range(40)], names)
    named = {"id_col": "the.id", "text_col": "the.text", "source_col": "the.source"}
    assert mixing.mix(df, **named).columns == names and mixing.mix(df, **named).count() > 40
    out = mixing.repetitions(df, **named)
    assert out.columns == [*names, "size", "source_size", "target", "repeats"] and out.count() == 40
    for r in out.groupBy("`the.source`").agg(F.sum(F.col("size") * F.col("repeats")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["target"] - r["taken"]) < 12
