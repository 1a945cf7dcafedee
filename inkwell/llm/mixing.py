"""Mixing sources to target weights: capped water-filling and seeded repetition.

The budget (a multiple of the corpus size) goes to the sources by weight. A
source whose share exceeds ``max_epochs`` times its size is clamped there and
the excess goes to the others by weight, until none is above. Within a source
every document is taken floor(epochs) times; the remaining fraction is met by
documents in the order of a seeded digest, as long as they fit, up to a cut. What is then
left to the target is filled by later documents that still fit: from the largest power of two of the size
down, the first in order of each, in FILL rounds; at the end by the one that comes nearest to the target. The cut is found without sorting a source: sizes are summed by digest
prefix, and only the documents of the one prefix that holds the cut are ordered.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words, of_row, packed, unpacked

#: The plan of so many sources is sent to every executor (about 1 kB each); that of more is joined by shuffling.
MAX_BROADCAST_SOURCES = 10_000
#: The driver gets a row per source; more are an error (group them first, hosts by domain for example).
MAX_SOURCES = 1_000_000
FILL = 2
#: Documents of a source that are put in order by one task, on average.
CELL = 50_000
WEIGHTS = (5, 2, 1)
BUDGET = Fraction(3, 2)
MAX_EPOCHS = 2


def water_fill(sizes: list[int], weights: list[int], budget: Fraction, max_epochs: int) -> list[Fraction]:
    """Targets of the sources; exact, so that no order of summation shows."""
    targets, free, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(budget)
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] >= total * max_epochs * sizes[i]}
        for i in over or free:
            targets[i] = Fraction(max_epochs * sizes[i]) if over else left * weights[i] / total
        if not over:
            break
        left -= sum(targets[i] for i in over)
        free -= over
    return targets


def digest(seed: int, doc_id: Column, text: Column) -> Column:
    """The order in which documents get a fractional repetition."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.crc32(F.coalesce(text, F.lit(""))).cast("string")))


def _filled(state: DataFrame, narrow: DataFrame, sent: Callable[[DataFrame], DataFrame], over: bool = False) -> DataFrame:
    """``state`` (source, cut, gap, extra) after a round: of the documents behind the cut that fit the gap, the first of each size class, from the largest class down, as long as they fit.

    ``sent`` says how a table of some rows a source reaches the documents. With ``over``, the one document that brings the sum nearest to the target, if it ends nearer than now.
    """
    beside = narrow.alias("n").join(sent(state).alias("s"), F.col("n.source").eqNullSafe(F.col("s.source")))
    open_to = (F.col("cut").isNull() | (F.col("digest") > F.col("cut"))) & ~F.array_contains("extra", F.col("digest"))
    if over:
        off = F.struct(F.abs(F.col("size") - F.col("gap")), "digest")
        first = beside.where((F.col("size") < 2 * F.col("gap")) & open_to).groupBy("n.source").agg(F.min_by("digest", off).alias("digest"))
    else:
        first = beside.where((F.col("size") <= F.col("gap")) & open_to).groupBy("n.source", F.floor(F.log2("size")).alias("class")).agg(F.min("digest").alias("digest"))
    same = (F.col("n.digest") == F.col("f.digest")) & F.col("n.source").eqNullSafe(F.col("f.source"))
    sized = narrow.alias("n").join(sent(first).alias("f"), same).groupBy("n.source", "n.digest").agg(F.sum("size").alias("size"))  # equal rows are taken together
    offers = sized.groupBy(F.col("source").alias("of")).agg(F.sort_array(F.collect_list(F.struct("size", "digest")), asc=False).alias("offers"))  # one of a class
    start = F.struct(F.col("gap").alias("gap"), F.col("extra").alias("extra"))
    most = 2.0 if over else 1.0
    take = lambda s, o: F.when((o["size"] < most * s["gap"]) | (o["size"] == s["gap"]), F.struct((s["gap"] - o["size"]).alias("gap"), F.concat(s["extra"], F.array(o["digest"])).alias("extra"))).otherwise(s)
    taken = F.when(F.col("offers").isNull(), start).otherwise(F.aggregate("offers", start, take))
    return state.join(offers, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "cut", taken.alias("t")).select("source", "cut", "t.gap", "t.extra")


def plan(docs: DataFrame, *, seed: int, weights=WEIGHTS, budget=BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of ``docs`` (source, id, text): source, source_size, target, whole (repetitions of every document), cut (largest digest that gets one more; null: none), extra (digests behind it that do)."""
    spark = docs.sparkSession
    narrow = materialise(docs.select("source", n_words(F.col("text")).alias("size"), digest(seed, F.col("id"), F.col("text")).alias("digest")).where("size > 0"), "mixing")
    every = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    # Documents are summed by source and the first digits of their digests; the digits are as many as it takes for about CELL documents to a cell, as one cell a source is put in order.
    prefix = max(3, math.ceil(math.log(max(1, narrow.count()) / CELL, 16)))
    sums = narrow.groupBy("source", F.substring("digest", 1, prefix).alias("prefix")).agg(F.sum("size").alias("size"))
    sized = every.join(sums.groupBy("source").agg(F.sum("size").alias("size")).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    found = [(r["source"], r["size"] or 0) for r in sized.select("source", "size").limit(MAX_SOURCES + 1).collect()]
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in found]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], budget * sum(sizes), max_epochs)
    epochs = [t / n if n else Fraction(0) for t, n in zip(targets, sizes)]
    rows = [(s, n, float(t), int(e), float(t - int(e) * n)) for (s, n), t, e in zip(found, targets, epochs)]
    goals = spark.createDataFrame(rows, "source string, source_size long, target double, whole long, rest double")

    same = F.col("g.source").eqNullSafe(F.col("p.source"))
    up_to = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.withColumn("end", F.sum("size").over(up_to))
    # The cell in which the sum passes what is left to take; behind the last one if it never does.
    at = running.alias("p").join(goals.alias("g"), same).where("rest > 0 and end - p.size <= rest and rest < end")
    at = at.select("g.source", "prefix", "rest", (F.col("end") - F.col("p.size")).alias("before"))
    inside = narrow.alias("n").join(at.alias("a"), F.col("n.source").eqNullSafe(F.col("a.source")) & (F.substring("n.digest", 1, prefix) == F.col("a.prefix")))
    in_order = Window.partitionBy("source").orderBy("digest").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # equal digests are taken together
    inside = inside.select("a.source", "digest", "rest", "before", "prefix", "size").withColumn("sum", F.col("before") + F.sum("size").over(in_order))
    # The cut is the last digest whose running sum fits, or the end of the prefix before.
    fits = F.col("sum") <= F.col("rest")
    cuts = inside.groupBy("source").agg(F.coalesce(F.max(F.when(fits, F.col("digest"))), F.min("prefix")).alias("cut"), (F.first("rest") - F.coalesce(F.max(F.when(fits, F.col("sum"))), F.first("before"))).alias("gap"))
    state = cuts.withColumn("extra", F.array().cast("array<string>"))
    few = len(rows) <= MAX_BROADCAST_SOURCES
    sent = F.broadcast if few else lambda table: table
    for _ in range(FILL):
        state = materialise(_filled(state, narrow, sent), "mixing-fill")
    state = materialise(_filled(state, narrow, sent, over=True), "mixing-fill")
    state = state.select(F.col("source").alias("s"), "cut", "extra")
    whole = goals.join(state, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "cut", F.coalesce("extra", F.array().cast("array<string>")).alias("extra"))
    found_plan = materialise(whole, "mixing-plan")
    return F.broadcast(found_plan) if few else found_plan


def _repeated(docs: DataFrame, *, seed: int = 42, weights=WEIGHTS, budget=BUDGET, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """row, plan and repeats."""
    rows = packed(docs).select("row", of_row(source_col).cast("string").alias("source"), of_row(id_col).alias("id"), of_row(text_col).alias("text"))
    chosen = plan(rows, seed=seed, weights=weights, budget=budget, max_epochs=max_epochs).select(F.col("source").alias("s"), F.struct("source_size", "target", "whole", "cut", "extra").alias("plan"))
    mark = digest(seed, F.col("id"), F.col("text"))
    # Without a document that fits before the cut it is null or a bare prefix, which is smaller than every digest that begins with it.
    more = F.coalesce(mark <= F.col("plan.cut"), F.lit(False)) | F.array_contains("plan.extra", mark)
    return rows.join(chosen, F.col("source").eqNullSafe(F.col("s"))).select("row", "plan", n_words(F.col("text")).alias("size"), (F.col("plan.whole") + more.cast("long")).alias("repeats"))


def repetitions(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with size, source_size, target and repeats (how often the mix takes the document).

    Null sources form one source, the last in order. Texts that are null or
    have no word have size 0 and follow the same rule, so they neither help nor
    hurt a target; a very long text is taken whole or not at all. What a source gives differs from its target by half
    its smallest document not taken once more at most, unless FILL rounds leave a larger gap. Repeated rows have one digest and are taken alike, ties by digest together. Input
    columns with the names of the added ones are replaced, all others kept. An empty table gives
    an empty one. Options: seed, weights, budget, max_epochs, id_col, text_col, source_col.
    """
    out = _repeated(docs, **options)
    return unpacked(out, docs.columns, {"size": F.col("size"), "source_size": F.col("plan.source_size"), "target": F.col("plan.target"), "repeats": F.col("repeats")})


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, whatever their names, a row for each repetition, by the rules of ``repetitions``."""
    taken = _repeated(docs, **options).where("repeats > 0")
    return unpacked(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))), docs.columns, {})
