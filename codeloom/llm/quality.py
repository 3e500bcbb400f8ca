"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted over the features in turn, add up to one lookup table
per feature; the strongest pairs of features get two-way tables afterwards.
A score is a sum of table cells, read for whole slices of documents at once.

The model is fitted on the driver from at most `sample` labelled rows (the
bound is a parameter; rows are taken in the order of a hash of their id).
Labels, language, source and id are never features.

Null and empty texts are scored like any other, as texts without words.  If no
labelled row can be used, or all have the same label, every score is the
smoothed share of label 1 (0.5 without labels).  Repeated rows get equal
scores, and scores of equal texts tie at any length; a null doc_id counts as not
held out.  Very long texts are counted whole, in slices of bounded bytes.  An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _tables, _text
from codeloom.llm._features import NAMES, Counts

SAMPLE = 20_000

#: Texts are counted in slices of so many bytes: temporary arrays are many times larger, and every task has its own.
SLICE = _text.PIECE // 4


@dataclass
class Model:
    """Lookup tables over binned features."""

    prior: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        for f, g, table in self.pairs:
            total += table[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-total))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Newton steps of a tree with so many leaves over ordered bins."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    cuts = [0, len(grad)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            k = np.arange(a + 1, b)
            gl, hl, gr, hr = g[k] - g[a], h[k] - h[a], g[b] - g[k], h[b] - h[k]
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
            gain[(hl < least) | (hr < least)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), int(k[gain.argmax()]))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(grad))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return out


def _quad(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and Newton steps of the best cut of a two-way table in four by one cut a side."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    gt, ht = g[-1, -1], h[-1, -1]
    parts = [(g[:-1, :-1], h[:-1, :-1]), (g[:-1, -1:] - g[:-1, :-1], h[:-1, -1:] - h[:-1, :-1]), (g[-1:, :-1] - g[:-1, :-1], h[-1:, :-1] - h[:-1, :-1])]
    parts.append((gt - sum(p[0] for p in parts), ht - sum(p[1] for p in parts)))
    gain = sum(a**2 / (b + 1) for a, b in parts)
    if not gain.size:
        return 0.0, np.zeros_like(grad)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = np.empty_like(grad)
    for (a, b), (u, v) in zip(parts, ((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))), strict=True):
        step[u, v] = a[i, j] / (b[i, j] + 1)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 64, leaves: int = 3, n_pairs: int = 8, coarse: int = 8) -> Model:
    """Boost feature by feature in cycles, then the strongest pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(prior=float(np.log(share / (1 - share))))
    if len(y) < 10 or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    model.coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, coarse + 1)[1:-1])) for f in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.prior)
    least = 2.0
    for _ in range(rounds):
        for f, b in enumerate(binned):
            p = 1 / (1 + np.exp(-total))
            n = len(model.tables[f])
            step = rate * _tree(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n), leaves, least)
            model.tables[f] += step
            total += step[b]
    cells = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.coarse)]
    sums = lambda f, g, v: np.bincount(cells[f] * (len(model.coarse[g]) + 1) + cells[g], v, (len(model.coarse[f]) + 1) * (len(model.coarse[g]) + 1)).reshape(len(model.coarse[f]) + 1, -1)
    p = 1 / (1 + np.exp(-total))
    found = sorted(((_quad(sums(f, g, y - p), sums(f, g, p * (1 - p)))[0], f, g) for f in range(x.shape[1]) for g in range(f)), reverse=True)[:n_pairs]
    tables = {(f, g): np.zeros((len(model.coarse[f]) + 1, len(model.coarse[g]) + 1)) for _, f, g in found}
    for _ in range(rounds // 3):
        for (f, g), table in tables.items():
            p = 1 / (1 + np.exp(-total))
            step = rate * _quad(sums(f, g, y - p), sums(f, g, p * (1 - p)))[1]
            table += step
            total += step[cells[f], cells[g]]
    model.pairs = [(f, g, t) for (f, g), t in tables.items()]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _counted(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, features) of runs of rows."""
    for a, b, data, offsets in _text.slices(batch, "text", SLICE):
        yield a, b, Counts(data, offsets).features()


def features(docs: DataFrame, keep: str) -> DataFrame:
    """(keep, one column per feature) of docs(keep, text)."""
    _tables.bounded_batches(docs.sparkSession)
    kind = docs.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in _counted(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(x[:, k]) for k in range(x.shape[1]))], [keep, *NAMES])

    return docs.select(keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{keep} {kind}, " + ", ".join(f"{n} double" for n in NAMES))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows that are not held out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")  # at most `sample` rows of 12 bytes
    # One row an id, whatever the table repeats, so that what reaches the driver is bounded by `sample`.
    some = some.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select(F.struct("doc_id", "quality").alias("label"), "text")
    got = features(some.select(F.to_json("label").alias("label"), "text"), "label").toPandas()
    if not len(got):
        return Model()
    y = got["label"].str.extract(r'"quality":(\d)', expand=False).astype(float).to_numpy()
    return fit(got[NAMES].to_numpy(float), y)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    model = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in _counted(batch):
                s = model.score(x)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(pa.int64()), batch.column(1)[a:b], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold; texts are not shuffled."""
    model = train(docs, labels, sample)
    _tables.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in _counted(batch):
                yield batch.slice(a, b - a).filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
