"""Line dedup: winnowing over hashes, by DataFrame expressions only.

Texts are compared by their words, case folded. A repeated passage may begin and
end inside a line of the file, so lines are wrapped first, after every word.

Winnowing: every word has the hash of a few words from there on; of each window of
successive words the one with the least hash is selected, the first of equal ones. Window and hash
fit in a run of ``min_words`` words, so what is selected in the window that begins with a run is
a matter of the run's words alone, and equal runs have the same fingerprint at the same place. The runs
of one selected word follow each other; the words that they cover are its block. Of equal blocks
all but the first go without a look at their runs. Only where blocks that differ share a fingerprint are
runs compared one by one, each with the first place of the same words. What lies in a run that stands earlier is deleted.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import scanned
from .common import SPACE_RUN, bound, materialise, n_words, of_row, packed, unpacked

MIN_WORDS = 50
#: Where lines are longer than a word, words that end in one of these characters do not end one (all others do: e, a, i, m, u, even digits, punctuation, whatever is not ASCII).
NO_BREAK = "bcdfghjklnoprstvwxy13579"

#: Words are selected by the hash of so many words from there on (fewer, if a fingerprint has fewer); the hashes of longer ranges are put together from these.
GRAM = 8

#: The bits of a key that hold the place in the text; those above are of the hash.
PLACE = 2**31 - 1


def sizes(min_words: int) -> tuple[int, int, int]:
    """(words of the longest line, lines of a window, lines of a fingerprint); the last two are powers of two, window + fingerprint <= min_words + 1."""
    power = lambda n: 1 << (max(1, n).bit_length() - 1)
    print_lines = power(min_words * 2 // 5)
    return 1, power(min_words - print_lines + 1), print_lines


def _spaced(text: Column) -> Column:
    """Whether other white space than one space between words is in a text without line ends."""
    return functools.reduce(Column.__or__, [F.startswith(text, F.lit(" ")), F.endswith(text, F.lit(" ")), *[F.contains(text, F.lit(x)) for x in ("  ", *"\t\x0b\x0c\r")]])


def _words(text: Column) -> Column:
    """The words of a text, lower-cased, joined by one space."""
    plain = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))
    return bound(plain, lambda p: F.when(_spaced(p), F.trim(F.regexp_replace(p, SPACE_RUN, " "))).otherwise(p))


def wrapped(words: Column, line: int) -> Column:
    """The lines of words joined by one space, broken by content."""
    if line == 1:
        return F.split(words, " ")
    return F.regexp_extract_all(words, F.lit(f"(?:[^ ]++ ){{0,{line - 1}}}?[^ ]++(?<![{NO_BREAK}])|[^ ]++"), F.lit(0))


def _doubled(items: Column, to: int, join: Callable[[Column, Column, int], Column], of: int = 1) -> Column:
    """For each element ``join`` over it and those after it, ``to`` of them in all (a power of two), by pairs of pairs; ``join`` is told how far apart they are, each item stands for ``of`` of them. Those with less after them are of no use."""
    if to <= of:
        return items
    return bound(_doubled(items, to // 2, join, of), lambda x: F.zip_with(x, F.slice(x, to // 2 + 1, F.size(x)), lambda a, b: join(a, b, to // 2)))


def _hashed(words: Column, gram: int) -> Column:
    """For each word the hash of so many words (GRAM at most) from there on: hashes of pairs, each shifted by its place, so that at least 58 bits of each count."""
    if gram == 1:
        return F.transform(words, lambda x: F.xxhash64(x))
    pairs = bound(words, lambda w: F.zip_with(w, F.slice(w, 2, F.size(w)), lambda x, y: F.xxhash64(x, y)))
    return _doubled(pairs, gram, lambda x, y, n: x.bitwiseXOR(F.shiftleft(y, n)), 2)


def _covering(hashes: Column, at: Column, n: Column, least: int, most: int, gram: int) -> Column:
    """The hash of the n words from a place on (``least`` to ``most``), from the hashes of ``gram`` words that cover them."""
    places = [F.least(F.lit(i), n - gram) if i + gram > least else F.lit(i) for i in range(0, most - gram, gram)]
    return F.xxhash64(n, *[F.get(hashes, at + i) for i in [*places, n - gram]])


def _blocks(words: Column, min_words: int) -> Column:
    """(at, print, block, begin, n) of the selected words: the place, the fingerprint, the hash of the block, its first run and the number of its runs."""
    _, window, print_lines = sizes(min_words)
    gram = min(GRAM, print_lines)
    place = lambda key: key.bitwiseAND(F.lit(PLACE)).cast("int")

    def of(hashes: Column) -> Column:
        runs = F.size(hashes) - (min_words - 1)
        keys = F.transform(hashes, lambda x, i: x.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long")))
        least = _doubled(keys, window, lambda x, y, n: F.when(y < x, y).otherwise(x))

        def block(at: Column, begin: Column, n: Column) -> Column:
            of_print = _covering(hashes, at, F.lit(print_lines), print_lines, print_lines, gram)
            of_block = _covering(hashes, begin, n + (min_words - 1), min_words, min_words + window - 1, gram)
            return F.struct(at.alias("at"), of_print.alias("print"), of_block.alias("block"), begin.alias("begin"), n.alias("n"))

        def cut(chosen: Column) -> Column:
            # The next word is selected as soon as the window holds it, if its hash is less, else when the last one is out.
            begin = lambda x, y: F.when(y < x, place(y) - (window - 1)).otherwise(place(x) + 1)
            begins = F.concat(F.array(F.lit(0)), F.transform(F.slice(chosen, 2, F.size(chosen)), lambda y, j: begin(F.get(chosen, j), y)))
            ends = lambda b, j: F.coalesce(F.get(b, j + 1), runs)
            return bound(begins, lambda b: F.transform(F.transform(chosen, lambda key, j: F.struct(place(key).alias("at"), F.get(b, j).alias("begin"), (ends(b, j) - F.get(b, j)).alias("n"))), lambda x: block(x["at"], x["begin"], x["n"])))

        return F.when(runs > 0, bound(F.array_distinct(F.slice(least, 1, runs)), cut))

    return bound(_hashed(wrapped(words, 1), gram), of)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row; doc, a hash of id and text. Rows of one id and text are one document."""
    text = F.coalesce(of_row(text_col), F.lit(""))
    return packed(docs).select("row", F.xxhash64(of_row(id_col), text).alias("doc"))


def _place(id_col: str) -> Column:
    """Nulls come last; ids of any type with an order."""
    return F.struct(of_row(id_col).isNull().alias("none"), of_row(id_col).alias("id"))


def _all_blocks(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(doc, id, at, print, block, begin, n) of the documents that may have ``min_words`` words."""
    long = _keyed(docs, id_col, text_col).where(F.length(of_row(text_col)) >= 2 * min_words - 1)
    return long.select("doc", _place(id_col).alias("id"), F.inline(bound(_words(of_row(text_col)), lambda w: _blocks(w, min_words))))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, id, at, print): the winnowed words of every text of ``min_words`` words or more; doc is a hash of id and text, at the place among the words."""
    return _all_blocks(docs, id_col, text_col, min_words).select("doc", "id", "at", "print")


def _later(rows: DataFrame, key: list[str], at: str, min_words: int) -> tuple[DataFrame, Column]:
    """The rows, dealt by ``key[0]`` and sorted, with the doc and place of the first row of their key; whether a row stands later than that (in one document without overlap)."""
    order = ["none", "id", "doc", at]
    first = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = rows.repartition(key[0]).sortWithinPartitions(*key, *order)
    found = dealt.withColumns({"first_doc": F.first("doc").over(first), "first_at": F.first(at).over(first)})
    return found, (F.col("doc") != F.col("first_doc")) | (F.col(at) >= F.col("first_at") + min_words)


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, cuts): the word ranges [first, last], apart from each other, whose words lie in runs of ``min_words`` words that stand earlier (in one document without overlap).

    The first of equal places is the one of the smallest id (null ids last), then of the smallest hash of id and text, then position.
    """
    gram = min(GRAM, sizes(min_words)[2])
    blocks = _all_blocks(docs, id_col, text_col, min_words).select("doc", "id.none", "id.id", "print", "block", "begin", "n")
    found, later = _later(blocks, ["print", "block"], "begin", min_words)
    alone = Window.partitionBy("print")
    found = found.withColumns({"later": later, "differ": F.min("block").over(alone) != F.max("block").over(alone)}).where("later or differ")
    whole = F.when(F.col("later"), F.struct("begin", (F.col("begin") + F.col("n") - 1).alias("end")))
    open_ = F.when(~F.col("later"), F.struct("print", "begin", "n"))
    near = materialise(found.groupBy("doc").agg(F.collect_list(whole).alias("whole"), F.collect_list(open_).alias("open")), "line-near")

    # The runs of blocks that differ.
    run = lambda h, b, i, low: F.struct(b["print"].alias("print"), _covering(h, i - low, F.lit(min_words), min_words, min_words, gram).alias("run"), i.alias("at"))
    each = lambda h, low: F.flatten(F.transform("open", lambda b: F.transform(F.sequence(b["begin"], b["begin"] + b["n"] - 1), lambda i: run(h, b, i, low))))
    low, high = F.array_min(F.col("open.begin")), F.array_max(F.transform("open", lambda b: b["begin"] + b["n"])) + (min_words - 1)
    some = lambda low: bound(_hashed(F.slice(wrapped(_words(of_row(text_col)), 1), low + 1, high - low), gram), lambda h: each(h, low))
    around = _keyed(docs, id_col, text_col).join(near.where("size(open) > 0").select("doc", "open").hint("shuffle_hash"), "doc")
    runs = around.select("doc", _place(id_col).alias("place"), F.inline(bound(low, some))).select("doc", "place.*", "print", "run", "at")
    found, later = _later(runs, ["print", "run"], "at", min_words)
    single = found.where(later).groupBy("doc").agg(F.collect_set("at").alias("single"))

    # Runs of the first words of neighbours: those at most min_words apart are one cut.
    all_runs = near.select("doc", "whole").join(single, "doc", "left")
    ranges = F.sort_array(F.concat("whole", F.coalesce(F.transform("single", lambda i: F.struct(i.alias("begin"), i.alias("end"))), F.array())))
    apart = lambda a, b: F.coalesce(b["begin"] - a["end"] > min_words, F.lit(True))
    begins = lambda r: F.filter(r, lambda x, i: apart(F.get(r, i - 1), x))
    ends = lambda r: F.filter(r, lambda x, i: apart(x, F.get(r, i + 1)))
    cuts = bound(ranges, lambda r: F.zip_with(begins(r), ends(r), lambda a, b: F.struct(a["begin"].alias("first"), (b["end"] + (min_words - 1)).alias("last"))))
    return all_runs.where("size(whole) > 0 or single is not null").select("doc", cuts.alias("cuts"))


def _counted(line: Column) -> Column:
    """``n_words`` of a line without a line end; where there are single spaces only, they are counted."""
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(_spaced(line), n_words(line)).when(line == "", 0).otherwise(spaces + 1).cast("long")


def _without_cuts(lines: Column, cuts: Column) -> Column:
    """The lines left without the words in ``cuts`` (in order, apart from each other); a line goes if all its words go, a blank one inside a cut."""
    counts = F.concat(F.transform(lines, _counted), F.array(F.lit(0).cast("long")))
    begins = scanned(counts, F.lit(0).cast("long"), lambda n, k: n + k, lambda n, k: n, "long")
    words = lambda raw: F.regexp_extract_all(raw, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = lambda own, first, last: F.slice(own, first.cast("int") + 1, F.greatest(last - first, F.lit(0)).cast("int"))

    def rest(raw, a, b, touching):
        """The words before, between and after the cuts that touch the line."""
        starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(touching, lambda c: F.least(c["last"] + 1, b) - a))
        ends = F.concat(F.transform(touching, lambda c: F.greatest(c["first"].cast("long"), a) - a), F.array(b - a))
        left = bound(words(raw), lambda own: F.array_join(F.flatten(F.zip_with(starts, ends, lambda s, e: part(own, s, e))), ""))
        return F.nullif(F.when(F.get(touching, 0)["first"] <= a, F.ltrim(left)).otherwise(left), F.lit(""))

    def line(raw, a, b):
        inside = F.exists(cuts, lambda c: (c["first"] < a) & (a <= c["last"]))
        gone = F.exists(cuts, lambda c: (c["first"] <= a) & (b <= c["last"] + 1))
        of_words = bound(F.filter(cuts, lambda c: (c["first"] < b) & (a <= c["last"])), lambda t: F.when(F.size(t) == 0, raw).otherwise(rest(raw, a, b, t)))
        return F.when(a == b, F.when(~inside, raw)).when(~gone, of_words)

    cut = bound(begins, lambda n: F.transform(lines, lambda raw, k: line(raw, F.get(n, k), F.get(n, k + 1))))
    return F.filter(cut, lambda x: x.isNotNull())


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text without what repeats an earlier run of at least ``min_words`` words, and n_lines and n_deleted (lines of the file before, lines of which nothing stays).

    Order is by id (any type with an order; nulls last), then, for different texts of one id, by a hash of id and text, then by position.
    Line breaks stay with the words left of each line; a line that is cut loses the white space at
    the cut and at its end. Blank lines go only inside a cut. A null text stays null and has no lines; an empty one stays.
    Rows of one id and text are one document: they stay alike, and only other documents count against them. Texts of
    fewer words, ties within a text (overlapping repeats) and texts that share no run stay as they are, however long. Input columns
    ``n_lines`` and ``n_deleted`` are replaced. An empty table gives an empty one.
    """
    names = docs.columns
    found = _keyed(docs, id_col, text_col).join(repeated(docs, id_col=id_col, text_col=text_col, min_words=min_words).hint("shuffle_hash"), "doc", "left")
    lines = F.split(of_row(text_col), "\n")
    found = found.withColumn("left", F.when(F.col("cuts").isNotNull(), _without_cuts(lines, F.col("cuts"))))
    kept = F.when(F.col("left").isNull(), of_row(text_col)).otherwise(F.array_join("left", "\n"))
    n_lines = F.when(of_row(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_deleted = F.when(F.col("left").isNull(), 0).otherwise(F.size(lines) - F.size("left")).cast("long")
    return unpacked(found, names, {"n_lines": n_lines, "n_deleted": n_deleted}, {text_col: kept})
