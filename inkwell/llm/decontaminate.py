"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items go into one automaton. Documents are
streamed through it; at each word it gives the longest suffix read so far that
occurs in an item. Where that length reaches the window, or a whole shorter
item ends, the words are hit. Documents stay where they are: no shuffle.

The automaton is sent to the executors, so its size is bounded: items are packed into
automata of at most ``max_words`` words each, and documents pass through them
one after another.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialise, of_row, packed, unpacked

WINDOW = 10
MAX_WORDS = 200_000
#: Texts that are Python strings at a time.
_PIECE = 256
#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences: per state its transitions, suffix link and longest length."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, [name for name, _ in items]
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in words] for _, words in items]
        for seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        n = len(self.next)
        inside: list[set[int]] = [set() for _ in range(n)]  # items that contain the state's strings
        whole: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (length, item) of the short items that end here
        for item, seq in enumerate(coded):
            v = 0
            for c in seq:
                v = u = self.next[v][c]
                while u > 0 and item not in inside[u]:
                    inside[u].add(item)
                    u = self.link[u]
            if 0 < len(seq) < window:
                whole[v].append((len(seq), item))
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.owners: list[frozenset[int]] = [frozenset()] * n  # items with the last `window` words of the state's longest string
        self.whole: list[list[tuple[int, int]]] = whole
        for v in order:
            up = self.link[v]
            if self.length[v] >= window:
                self.owners[v] = self.owners[up] if self.length[up] >= window else frozenset(inside[v])
            if whole[up]:
                whole[v] = whole[v] + whole[up]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of the words that are hit, merged where they overlap or touch, and the items found."""
        nxt, link, length, whole, owners, window = self.next, self.link, self.length, self.whole, self.owners, self.window
        spans: list[list[int]] = []
        items: set[int] = set()
        v = run = 0
        for i, c in enumerate(map(self.vocab.get, words)):
            if c is None:
                v = run = 0
                continue
            to = nxt[v].get(c)
            while to is None and v:
                v = link[v]
                run = length[v]
                to = nxt[v].get(c)
            if to is None:
                run = 0
                continue
            v = to
            run += 1
            if run >= window:
                items |= owners[v]
                start = i + 1 - run
            elif whole[v]:
                start = i + 1
            else:
                continue
            for n, item in whole[v]:
                if n <= run:
                    items.add(item)
                    start = min(start, i + 1 - n)
            if start > i:
                continue
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append([start, i + 1])
        return [tuple(s) for s in spans], items


def automata(benchmark: DataFrame, *, id_col: str, text_col: str, window: int, max_words: int) -> Iterator[Automaton]:
    """One automaton for each run of items (in order of id) of at most ``max_words`` words. A longer item is read as several that share ``window`` - 1 words, so that no window is lost."""
    block: list[tuple[str, list[bytes]]] = []
    held = 0
    rows = packed(benchmark).select(of_row(id_col).cast("string").alias("id"), of_row(text_col).alias("text")).orderBy("id", "text")
    size = max(max_words, 2 * window)
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        starts = range(0, max(1, len(words) - window + 1), size - window + 1) if len(words) > size else (0,)
        for at in starts:
            part = words[at : at + size]
            if block and held + len(part) > size:
                yield Automaton(block, window)
                block, held = [], 0
            block.append((row["id"] or "", part))
            held += len(part)
    yield Automaton(block, window)


def _scanner(shared: Broadcast):
    @F.pandas_udf(FOUND)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = shared.value
        for batch in texts:
            rows = []
            for text in batch:
                words = words_of(text)
                spans, items = automaton.scan(words)
                rows.append((len(words), [{"start": s, "end": e} for s, e in spans], sorted({automaton.ids[i] for i in items})))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return scan


def _found(rows: DataFrame, text: Column, automatons: Iterator[Automaton]) -> DataFrame:
    """``rows`` with ``found``: n_words, spans and items over all automata, by one pass for each."""
    parts: list[str] = []
    for k, automaton in enumerate(automatons):
        if k:  # only one automaton at a time in an executor's memory
            rows = materialise(rows, "decontaminate")
        shared = rows.sparkSession.sparkContext.broadcast(automaton)
        parts.append(f"_found_{k}")
        rows = rows.withColumn(parts[-1], _scanner(shared)(text))
    if len(parts) == 1:
        return rows.withColumnRenamed(parts[0], "found")
    hits = F.array_sort(F.concat(*[F.col(f"{p}.spans") for p in parts]))
    join = lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(done, F.array(s)))
    merged = F.aggregate(hits, F.array().cast("array<struct<start:int,end:int>>"), join)
    items = F.array_sort(F.array_distinct(F.concat(*[F.col(f"{p}.items") for p in parts])))
    return rows.withColumn("found", F.struct(F.col(f"{parts[0]}.n_words").alias("n_words"), merged.alias("spans"), items.alias("items"))).drop(*parts)


def find(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with ``found``: n_words, spans (word positions that are hit) and items (ids found, distinct, sorted as strings).

    Null and wordless texts have no words and no hits; null or wordless items
    hit nothing; an item of fewer than ``window`` words is a window as a whole.
    Texts and items may be of any length. Repeated items count once by id (a null id is the empty string), ties and repeated rows
    get equal results. An input column named ``found`` is replaced, all others are kept. Empty tables give empty results or no hits.
    """
    out = _found(packed(docs), of_row(text_col), automata(benchmark, id_col=item_id, text_col=item_text, window=window, max_words=max_words))
    return unpacked(out, docs.columns, {"found": F.col("found")})


def cut(text: str, spans) -> str:
    """``text`` without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    kept, end = [], 0
    for first, stop in spans:
        kept.append(text[end : at[first][0]])
        end = at[stop - 1][1]
    return "".join([*kept, text[end:]])


def _cutter(shared: Broadcast):
    """Cuts by one automaton until it finds nothing more."""

    kinds = {"text": pa.string(), "n_words": pa.int64(), "n_cut": pa.int64()}

    def one(automaton: Automaton, text: str | None) -> tuple[str | None, int, int]:
        words = words_of(text)
        n_words, n_cut = len(words), 0
        while spans := automaton.scan(words)[0]:
            n_cut += sum(e - s for s, e in spans)
            text = cut(text, spans)
            words = words_of(text)
        return text, n_words, n_cut

    @F.arrow_udf("text string, n_words long, n_cut long")
    def rid(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = shared.value
        for batch in batches:
            done = []
            for at in range(0, max(1, len(batch)), _PIECE):  # a few texts at a time are Python's, so that memory stays small
                rows = [one(automaton, text) for text in batch.slice(at, _PIECE).to_pylist()]
                columns = list(zip(*rows)) if rows else [()] * len(kinds)
                done.append(pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds)))
            yield pa.concat_arrays(done)
        give_back()

    return rid


@F.pandas_udf(T.StringType())
def _cut_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut(t, [(x["start"], x["end"]) for x in s]) if s is not None and len(s) else t for t, s in zip(texts, spans)], dtype=object)


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", max_share: float = 0.5, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut from the text, and documents of which more than ``max_share`` of the words are hit go.

    Cutting can bring the words around a span together, so a text is searched again, by every automaton, until
    nothing is found: the result does not depend on how items are packed. Null, empty and wordless texts stay as they are; texts of any length are searched
    whole; ties and repeated rows get equal results. All columns are kept, whatever their names, with
    their values. Empty tables give empty results, or all documents unchanged.
    """
    packs = lambda: automata(benchmark, id_col=item_id, text_col=item_text, window=window, max_words=max_words)
    few = list(itertools.islice(packs(), 2))
    rows = packed(docs).select("row", of_row(text_col).alias("text"))
    if len(few) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(few[0])
        rows = rows.select("row", _cutter(shared)("text").alias("done")).select("row", "done.text", F.col("done.n_words").alias("words"), F.col("done.n_cut").alias("cut"))
    else:
        rows, busy = rows.withColumns({"words": F.lit(None).cast("long"), "cut": F.lit(0).cast("long"), "todo": F.lit(True)}), True
        while busy:  # a round marks what all automata find, then cuts it at once; texts without a hit are not read again
            rows = _found(rows, F.when(F.col("todo"), F.col("text")), packs())
            n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
            rows = rows.select("row", _cut_spans("text", "found.spans").alias("text"), F.coalesce("words", "found.n_words").alias("words"), (F.col("cut") + n_hit).alias("cut"), (n_hit > 0).alias("todo"))
            rows = materialise(rows, "decontaminate")
            busy = not rows.where("todo").isEmpty()
    return unpacked(rows.where(F.col("cut") <= max_share * F.col("words")), docs.columns, {}, {text_col: F.col("text")})
