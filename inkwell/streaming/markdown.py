"""Markdown in Structured Streaming: parsing keeps no state between documents, so a stream of documents becomes a stream of tokens or of HTML."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import normalize_reference
from ..operators import blocks
from ..plans.config import Syntax


def stream_blocks(docs: DataFrame, syntax: Syntax | None = None, **columns) -> DataFrame:
    """Block tokens of a stream of documents (append mode, no watermark)."""
    return blocks.parse(docs, syntax, **columns)


def count_by_window(docs: DataFrame, ts_col: str, *, width: str = "10 minutes", late: str = "20 minutes", syntax: Syntax | None = None, text_col: str = "text") -> DataFrame:
    """Block types per event-time window; documents later than ``late`` no longer count."""
    timed = docs.withWatermark(ts_col, late).select(F.col(ts_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = F.transform(F.filter("tokens", lambda t: (t["nesting"] >= 0) & ~t["type"].isin("inline", blocks.DEFINITION)), lambda t: t["type"])
    found = blocks.nested(timed, syntax).select(F.window("doc_id", width).alias("window"), F.explode(kinds).alias("type"))
    return found.groupBy("window", "type").count()


_BEST = "at long, doc_id string, pos int, href string, title string, n_later long, final boolean"
_DEFINED = "label string, href string, title string, doc_id string, at long"


class _FirstWins(StatefulProcessor):
    """Of each label the first definition by time, document and place. It is given out when the watermark has passed its time, as none before can come then; what comes later is counted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.best = handle, handle.getValueState("best", _BEST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["at", "doc_id", "pos"], kind="stable")
        best = self.best.get() if self.best.exists() else None
        first, later = found.iloc[0], len(found) - (best is None)
        new = (int(first["at"]), str(first["doc_id"]), int(first["pos"]), str(first["href"]), str(first["title"]))
        if best is not None:
            later += best[5]
            if best[6] or tuple(best[:3]) <= new[:3]:
                new = tuple(best[:5])
        final = bool(best is not None and best[6])
        if not final and (best is None or best[0] != new[0]):
            if best is not None:
                self.handle.deleteTimer(-(-best[0] // 1000))
            self.handle.registerTimer(-(-new[0] // 1000))
        self.best.update((*new, int(later), final))
        yield pd.DataFrame([], columns=["label", "href", "title", "doc_id", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, doc_id, pos, href, title, later, _ = self.best.get()
        self.best.update((at, doc_id, pos, href, title, later, True))
        yield pd.DataFrame([(key[0], href, title, doc_id, at)], columns=["label", "href", "title", "doc_id", "at"])

    def close(self) -> None:
        pass


def stream_definitions(docs: DataFrame, ts_col: str, *, late: str = "20 minutes", syntax: Syntax | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, href, title, doc_id, ts): the definition that counts for each label across a stream of documents, once it is certain.

    Documents may arrive in any order; one later than ``late`` behind the newest no longer counts. A label's state is one row however
    often it is defined. The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Ids become strings; a null id is an empty one.
    """
    named = docs.select(F.struct(F.col(ts_col).alias("ts"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id")).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id.ts is not null")
    defined = F.filter("tokens", lambda t: t["type"] == blocks.DEFINITION)
    found = blocks.nested(named, syntax).select("doc_id.*", F.unix_micros("doc_id.ts").alias("at"), F.inline(F.transform(defined, lambda t: F.struct(t["pos"].alias("pos"), normalize_reference(t["info"]).alias("label"), t["content"].alias("href"), t["markup"].alias("title")))))
    first = found.withWatermark("ts", late).groupBy("label").transformWithStateInPandas(_FirstWins(), outputStructType=_DEFINED, outputMode="Append", timeMode="EventTime")
    return first.select("label", "href", "title", "doc_id", F.timestamp_micros("at").alias("ts"))
