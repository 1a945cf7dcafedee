"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Lower-cased word n-grams (orders 1 and 2) are hashed into a fixed number of
buckets. Two multinomials over the buckets are counted: the raw one over every
document, the trusted one over labelled documents of good quality without
toxic content. A document's score is the mean over its n-grams of
log(trusted / raw); documents below a threshold are rejected. The scale of scores depends on how much
is trusted, so the threshold is fitted to the scores of all labelled documents. A mean hides a few
words of abuse in a long text, so words (by their hashes) with an extreme ratio of toxic
to trusted documents are found as well, and a document that holds one is rejected. All of it is
DataFrame expressions: counting is one aggregation with partial sums, scoring
needs no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, of_row, packed, unpacked, words_of

BUCKETS = 10_000
#: At most so many trusted documents fit the target (those with the smallest hash of their id); so many trusted ones and so many toxic ones give the toxic words.
MAX_TRUSTED, MAX_TOXIC = 20_000, 5000
#: So many labels are sent to every executor, so that only labelled texts are scored for the threshold; with more, all are scored and joined by id.
MAX_BROADCAST_LABELS = 1_000_000
#: A toxic word stands in this share of the toxic documents, in so many of them at least, and in them so many times as often as in trusted ones; at most so many words (those with the most toxic documents).
TOXIC_SHARE, TOXIC_LEAST, TOXIC_RATIO, TOXIC_WORDS = 0.05, 5, 20.0, 1000
#: Scores below are rejected where the labels give no threshold.
THRESHOLD = -0.06
#: A fitted threshold rejects at most this share of the labelled good documents.
MAX_LOST = 0.01
#: Bins of a score of 1.
BINS = 10_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of every word, in order; all that follows works on these."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _bigram(hashes: Column, x: Column, i: Column) -> Column:
    """A hash of the word x at i and the next; null at the last word."""
    return x.bitwiseXOR(F.shiftleft(F.get(hashes, i + 1), 1))


def _bucket(h: Column, n: int) -> Column:
    return F.pmod(h, F.lit(n)).cast("int")


def grams(hashes: Column) -> Column:
    """A hash of every 1- and 2-gram, given a column of word hashes (null in place of the 2-gram after the last word)."""
    return F.concat(hashes, F.transform(hashes, lambda x, i: _bigram(hashes, x, i)))


def mean_ratio(hashes: Column, ratios: Column, n: int) -> Column:
    """The mean of the ratios over all 1- and 2-grams; null without words."""
    each = F.transform(hashes, lambda x, i: F.get(ratios, _bucket(x, n)) + F.coalesce(F.get(ratios, _bucket(_bigram(hashes, x, i), n)), F.lit(0.0)))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.nullif(2 * F.size(hashes) - 1, F.lit(-1))


def n_repeat_words(hashes: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, the first occurrence included.

    Windows are compared by a 64-bit hash of the hashes of their words. They are sorted by it with their
    positions; equal neighbours are the repeated ones; the words of the
    overlapping windows are then counted once each, in order of position.
    """
    windows = F.transform(F.slice(hashes, 3, F.greatest(F.size(hashes), F.lit(1))), lambda x, i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), x))
    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    repeated = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))
    covered = lambda at: F.aggregate(
        F.sort_array(F.transform(at, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(s["end"], i)).alias("n"), (i + 3).alias("end")),
        lambda s: s["n"],
    )
    counted = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(bound(placed(h), repeated)))
    return bound(windows, counted).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[{SYMBOLS}]")).cast("long")


def word_chars(text: Column) -> Column:
    full = F.coalesce(text, F.lit(""))
    return (F.length(full) - F.regexp_count(full, F.lit(r"[\x20\x09-\x0D]"))).cast("long")


def _ids(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Labels with ids of the documents' type; those that have no such value name no document."""
    return labels.select(F.col("doc_id").try_cast(docs.schema["doc_id"].dataType).alias("id"), "quality", "toxic").where("id is not null")


def _some(labels: DataFrame, condition: str, most: int) -> DataFrame:
    """A bounded sample of the labelled ids, so it can be broadcast."""
    return labels.where(condition).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most)


def _texts(docs: DataFrame) -> DataFrame:
    return packed(docs).select(of_row("doc_id").alias("id"), of_row("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, *, n: int = BUCKETS, max_trusted: int = MAX_TRUSTED, smoothing: float = 1.0, prior: float = 10.0) -> list[float]:
    """log(trusted / raw) for every bucket, from counts over all of ``docs``. The trusted multinomial is smoothed towards the raw one (``prior`` counts a bucket), so few trusted documents judge mildly, and none not at all."""
    good = _some(_ids(labels, docs), "quality = 1 and coalesce(toxic, 0) = 0", max_trusted)
    known = _texts(docs).join(F.broadcast(good.withColumn("trusted", F.lit(1))), "id", "left")
    found = known.select(F.explode(bound(word_hashes(F.lower("text")), grams)).alias("gram"), "trusted").where("gram is not null")
    rows = found.groupBy(_bucket(F.col("gram"), n).alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("trusted")).collect()  # n rows at most
    raw, trusted = [0] * n, [0] * n
    for r in rows:
        raw[r["bucket"]], trusted[r["bucket"]] = r["raw"], r["trusted"]
    all_raw, all_trusted, prior = sum(raw) + smoothing * n, sum(trusted), prior * n
    base = [(r + smoothing) / all_raw for r in raw]
    return [math.log((t + prior * b) / (all_trusted + prior) / b) for t, b in zip(trusted, base)]


def toxic_words(docs: DataFrame, labels: DataFrame, *, most: int = MAX_TOXIC) -> list[int]:
    """Hashes of the lower-cased words by which toxic documents differ from trusted ones; none without labelled documents of both kinds."""
    labels = _ids(labels, docs)
    bad = _some(labels, "toxic = 1", most).withColumn("toxic", F.lit(1))
    good = _some(labels, "quality = 1 and coalesce(toxic, 0) = 0", most).withColumn("toxic", F.lit(0))
    either = bad.unionByName(good).groupBy("id").agg(F.max("toxic").alias("toxic"))
    held = _texts(docs).join(F.broadcast(either), "id").select("toxic", F.array_distinct(word_hashes(F.lower("text"))).alias("words"))
    total = {r["toxic"]: r["count"] for r in held.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return []
    # The outer form, as for the other Spark asks below the join whether there are words, of all texts.
    words = held.select("toxic", F.explode_outer("words").alias("word")).where("word is not null").groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    share = F.col("bad") / total[1]
    strong = words.where((F.col("bad") >= TOXIC_LEAST) & (share >= TOXIC_SHARE) & (share >= TOXIC_RATIO * (F.col("good") + 0.5) / total[0]))
    return [r["word"] for r in strong.orderBy(F.desc("bad"), "word").limit(TOXIC_WORDS).collect()]


def fit_threshold(docs: DataFrame, labels: DataFrame, ratios: Column, *, n: int = BUCKETS) -> float:
    """The score below which documents are rejected: between the score that MAX_LOST of the good labelled documents are under and the next lower one of a bad one.

    Good and bad go by ``quality``, over all labelled documents of MIN_WORDS words or more; toxic ones are neither. Without such scores, or with no bad one lower, THRESHOLD.
    """
    known = _ids(labels, docs).where("quality in (0, 1) and coalesce(toxic, 0) = 0").select("id", "quality").distinct()
    score = bound(word_hashes(F.lower("text")), lambda h: F.when(F.size(h) >= MIN_WORDS, mean_ratio(h, ratios, n))).alias("score")
    if known.limit(MAX_BROADCAST_LABELS + 1).count() <= MAX_BROADCAST_LABELS:
        scored = _texts(docs).join(F.broadcast(known), "id").select("quality", score)  # a filter on the score would be pushed below the join, to all texts
    else:
        scored = _texts(docs).select("id", score).where("score is not null").join(known, "id")
    bins: dict[int, dict[int, int]] = {0: {}, 1: {}}  # scores are means of bounded ratios, so there are some 100,000 bins at most; counts do not depend on the order of rows
    for r in scored.groupBy("quality", F.floor(F.col("score") * BINS).alias("bin")).count().collect():
        if r["bin"] is not None:
            bins[r["quality"]][r["bin"]] = r["count"]
    if not bins[0] or not bins[1]:
        return THRESHOLD
    spare = MAX_LOST * sum(bins[1].values())
    for least in sorted(bins[1]):
        spare -= bins[1][least]
        if spare < 0:
            break
    lower = [x for x in bins[0] if x < least]
    return (least + max(lower) + 1) / 2 / BINS if lower else THRESHOLD


def judge(docs: DataFrame, labels: DataFrame, *, n: int = BUCKETS, max_trusted: int = MAX_TRUSTED, threshold: float | None = None) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, n_toxic and kept.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word
    windows. n_toxic: how many different toxic words the text holds. kept: not base_failed, score >= threshold (by default
    the one of ``fit_threshold``) and no toxic word. A null or wordless
    text has all counts 0 and a null score, and fails the base rules. Ties and repeated rows
    get equal verdicts; texts of any length are read whole. Labels may be empty, repeated or null; where one id has several, one
    toxic label makes it toxic. Ids are compared in the documents' type. Input columns
    with the names of the added ones are replaced, all others kept. An empty table gives an empty one.
    """
    out, columns = _judged(docs, labels, n=n, max_trusted=max_trusted, threshold=threshold)
    return unpacked(out, docs.columns, columns)


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns alone, whatever the names of these."""
    out, columns = _judged(docs, labels, **options)
    return unpacked(out.where(columns["kept"]), docs.columns, {})


def _judged(docs: DataFrame, labels: DataFrame, *, n: int = BUCKETS, max_trusted: int = MAX_TRUSTED, threshold: float | None = None) -> tuple[DataFrame, dict[str, Column]]:
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in fit(docs, labels, n=n, max_trusted=max_trusted))), ",").cast("array<double>")
    if threshold is None:
        threshold = fit_threshold(docs, labels, ratios, n=n)
    toxic = F.split(F.lit(",".join(map(str, toxic_words(docs, labels))) or "0"), ",").cast("array<bigint>")
    text = of_row("text")
    lowered = bound(word_hashes(F.lower(text)), lambda h: F.struct(mean_ratio(h, ratios, n).alias("score"), F.size(F.array_intersect(h, toxic)).cast("long").alias("n_toxic")))
    counted = bound(
        word_hashes(text),
        lambda h: F.struct(
            F.size(h).cast("long").alias("n_words"), word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"),
            n_dup_lines(text).alias("n_dup_lines"), n_repeat_words(h).alias("n_repeat_words"), lowered.alias("lowered"),
        ),
    )
    # A generator, so that a filter on what it gives is not pushed below, where each mention would count anew.
    out = packed(docs).select("row", F.explode(F.array(counted)).alias("found"))
    base = {k: F.col("found").getField(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
    score, n_toxic = F.col("found.lowered.score"), F.col("found.lowered.n_toxic")
    kept = ~failed & F.coalesce(score >= threshold, F.lit(False)) & (n_toxic == 0)
    return out, base | {"base_failed": failed, "score": score, "n_toxic": n_toxic, "kept": kept}
