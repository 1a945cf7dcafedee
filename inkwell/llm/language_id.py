"""Language ID by a byte convolutional network.

Texts are folded to a small byte alphabet and cut into fixed-length windows.
Filters of several widths slide over a window's bytes, each keeps its maximum,
and a softmax over these gives the window's languages; a document gets the mean
over all its windows. Training is plain numpy on the driver, on windows of a
bounded sample of labelled documents; the executors apply the network to
batches of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import of_row, packed, unpacked

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Training takes at most so many documents (smallest hash of the id) and windows of each.
MAX_DOCS, MAX_WINDOWS = 3000, 4
UNKNOWN = "und"

#: 0 pads; a-z (A-Z folded), the space (all ASCII white space), digits, other ASCII; each byte beyond ASCII is its own.
_FOLD = np.array([3 if chr(b) in "0123456789" else 2 if chr(b) in " \t\n\r\x0b\f" else 4 + (b | 32) - 97 if chr(b).isalpha() and b < 128 else 1 if b < 128 else 30 + b - 128 for b in range(256)], dtype=np.uint8)
SYMBOLS = 30 + 128


def windows(text: str, length: int = LENGTH) -> np.ndarray:
    """All of a text as rows of ``length`` symbols; the last row is padded."""
    data = _FOLD[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)]
    rows = max(1, -(-len(data) // length))
    out = np.zeros(rows * length, dtype=np.uint8)
    out[: len(data)] = data
    return out.reshape(rows, length)


class Network:
    """tables[w][i]: what each symbol at offset i adds to the filters of width w; out, bias: the softmax layer."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.tables = {w: rng.normal(0, 0.3 / np.sqrt(w), (w, SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), dtype=np.float32)

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the cross-entropy; classes weigh alike. Only the place of each filter's maximum has a gradient."""
        rng = np.random.default_rng(seed)
        weight = len(y) / (len(self.classes) * np.maximum(1, np.bincount(y, minlength=len(self.classes))))
        params = [*self.tables.values(), self.out, self.bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at : at + batch]
                xb, yb = x[rows], y[rows]
                pooled, places = [], []
                for w, table in self.tables.items():
                    n = xb.shape[1] - w + 1
                    r = sum(table[i][xb[:, i : i + n]] for i in range(w))
                    places.append(r.argmax(axis=1))
                    pooled.append(np.take_along_axis(r, places[-1][:, None, :], axis=1)[:, 0, :])
                pooled = np.maximum(np.concatenate(pooled, axis=1), 0)
                dz = self._softmax(pooled)
                dz[np.arange(len(yb)), yb] -= 1
                dz *= (weight[yb] / len(yb))[:, None].astype(np.float32)
                dp = (dz @ self.out.T) * (pooled > 0)
                grads = []
                for k, (w, table) in enumerate(self.tables.items()):
                    g, own = np.zeros_like(table), dp[:, k * FILTERS : (k + 1) * FILTERS]
                    for i in range(w):
                        np.add.at(g[i], (np.take_along_axis(xb, places[k] + i, axis=1), np.arange(FILTERS)[None, :]), own)
                    grads.append(g)
                grads += [pooled.T @ dz, dz.sum(axis=0)]
                step += 1
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def compiled(self) -> Network:
        """Sums of two neighbouring symbols' tables, so that applying takes fewer steps."""
        t = self.tables
        self.pairs = {w: [np.ascontiguousarray((t[w][i][:, None, :] + t[w][i + 1][None, :, :]).reshape(-1, FILTERS)) for i in range(0, w - 1, 2)] for w in WIDTHS}
        return self

    def apply(self, x: np.ndarray, chunk: int = 32) -> np.ndarray:
        """Class probabilities of each window."""
        out = np.empty((len(x), len(self.classes)), dtype=np.float32)
        for at in range(0, len(x), chunk):
            xb = x[at : at + chunk]
            two = xb[:, :-1].astype(np.int32) * SYMBOLS + xb[:, 1:]
            pooled = []
            for w in WIDTHS:
                n = xb.shape[1] - w + 1
                r = self.pairs[w][0].take(two[:, :n], axis=0)
                for k, table in enumerate(self.pairs[w][1:], 1):
                    r += table.take(two[:, 2 * k : 2 * k + n], axis=0)
                if w % 2:
                    r += self.tables[w][w - 1].take(xb[:, w - 1 : w - 1 + n], axis=0)
                pooled.append(r.max(axis=1))
            out[at : at + chunk] = self._softmax(np.maximum(np.concatenate(pooled, axis=1), 0))
        return out


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, max_docs: int = MAX_DOCS, max_windows: int = MAX_WINDOWS) -> Network | None:
    """A network trained on text and lang of documents that are not held out; None if there is none with a letter.

    Of rows with the same id, text and lang one counts.
    """
    labelled = packed(docs).select(of_row("doc_id").alias("id"), of_row("text").alias("text"), of_row("lang").cast("string").alias("label"))
    labelled = labelled.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("id")))
    row = F.xxhash64(F.col("id"), "text", "label").alias("row")
    chosen = labelled.select(row).distinct().orderBy("row").limit(max_docs)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, label, text in zip(part["row"], part["label"], part["text"]):
                w = windows(text)
                at = sorted({round(i * (len(w) - 1) / max(1, max_windows - 1)) for i in range(max_windows)})
                rows += [(name, i, label, w[i].tobytes()) for i in at]
            yield pd.DataFrame(rows, columns=["row", "at", "label", "window"])

    sample = labelled.select(row, "label", "text").join(F.broadcast(chosen), "row").mapInPandas(cut, "row long, at long, label string, window binary")
    rows = sorted((r["label"], bytes(r["window"])) for r in sample.dropDuplicates(["row", "at"]).collect())  # max_docs * max_windows windows at most
    if not rows:
        return None
    classes = sorted({label for label, _ in rows})
    network = Network(classes)
    network.train(np.stack([np.frombuffer(w, dtype=np.uint8) for _, w in rows]), np.array([classes.index(label) for label, _ in rows]))
    return network.compiled()


def identify(docs: DataFrame, network: Network | None, *, text_col: str = "text", per_call: int = 4096) -> DataFrame:
    """``docs`` with lang_pred and score (the mean probability of that language over all windows).

    ``und`` with score 0 for null texts, texts without a letter, and where no
    network could be trained. Every byte of a text is in a window. Repeated rows and ties
    get equal predictions (the first class in order wins a tie). Input
    columns with the names of the added ones are replaced. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a few hundred kB, whatever the input

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for part in parts:
            names, scores = [UNKNOWN] * len(part), [0.0] * len(part)
            held: list[np.ndarray] = []
            owners: list[int] = []
            sums = np.zeros((len(part), len(net.classes) if net else 1))

            def flush() -> None:
                if held:
                    np.add.at(sums, np.repeat(owners, [len(h) for h in held]), net.apply(np.concatenate(held)))
                    held.clear()
                    owners.clear()

            counts = np.zeros(len(part), dtype=np.int64)
            waiting = 0
            for i, text in enumerate(part):
                if net is None or text is None or not any(map(str.isalpha, text)):
                    continue
                w = windows(text)
                counts[i] = len(w)
                held.append(w)
                owners.append(i)
                waiting += len(w)
                if waiting >= per_call:
                    flush()
                    waiting = 0
            flush()
            for i in np.flatnonzero(counts):
                best = int(sums[i].argmax())
                names[i], scores[i] = net.classes[best], min(1.0, max(0.0, float(sums[i, best] / counts[i])))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    found = packed(docs).select("row", predict(of_row(text_col)).alias("found"))
    return unpacked(found, docs.columns, {"lang_pred": F.col("found.lang_pred"), "score": F.col("found.score")})
