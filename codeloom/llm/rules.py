"""Quality rules as weak supervision.

Every rule votes good, bad or abstains on a text.  Expectation-maximisation
over all documents estimates how accurate each rule is; the posterior
probability of good quality replaces passing every rule.  Documents are first
counted by their pattern of votes, of which there are at most 3**rules, so
what the driver sees is bounded whatever the number of documents.

Null and empty texts have no words: they fail the base rules.  Rows are
independent, so repeated rows get equal verdicts; without any document there
is nothing to estimate and the result is empty.  Very long texts are counted
whole, in slices of bounded bytes.  A posterior of exactly the bound keeps the
text; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _tables, _text
from codeloom.llm._features import NAMES, Counts

#: Rules: feature, the interval beyond which a rule votes bad, and the interval in which it votes good (none: it looks for one fault and abstains otherwise).
RULES = [
    ("log_words", (np.log1p(50), np.inf), (np.log1p(80), np.inf)),
    ("mean_length", (2.2, 12.0), (3.0, 9.0)),
    ("alphabetic", (0.6, 1.0), (0.85, 1.0)),
    ("stopped_lines", (0.05, 1.0), (0.6, 1.0)),
    ("symbols", (0.0, 0.05), None),
    ("upper", (0.0, 0.5), None),
    ("repeat_words", (0.0, 0.5), None),
    ("dup_lines", (0.0, 0.4), None),
    ("top_word", (0.0, 0.3), None),
    ("bangs", (0.0, 0.3), None),
    ("pipes", (0.0, 0.05), None),
    ("digits", (0.0, 0.3), None),
]

#: Rules are better than chance: of good texts, a rule calls at most this share bad.  Without such a bound the classes may turn into any kinds of text.
FALSE_ALARM = 0.01


def votes(x: np.ndarray) -> np.ndarray:
    """-1 bad, 0 abstain, 1 good: one row per document, one column per rule."""
    out = np.zeros((len(x), len(RULES)), np.int8)
    for k, (name, fair, good) in enumerate(RULES):
        v = x[:, NAMES.index(name)]
        out[:, k] = np.where((v < fair[0]) | (v > fair[1]), -1, 0)
        if good:
            out[(v >= good[0]) & (v <= good[1]), k] = 1
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1]))


def unpack(codes: np.ndarray) -> np.ndarray:
    return ((codes[:, None] // 3 ** np.arange(len(RULES))) % 3 - 1).astype(np.int8)


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> dict[int, float]:
    """Posterior probability of good quality for each pattern, by expectation-maximisation.

    Classes: good, and one kind of bad for each rule, as faults hardly ever come together and one class
    for all bad texts would let the many rules that find nothing outvote the one that does.
    """
    if not len(codes):
        return {}
    v = unpack(codes)
    hit = np.stack([v == k for k in (-1, 0, 1)], 2).astype(float)
    bad = (v < 0).astype(float)
    post = np.concatenate([np.where(bad.any(1), 0.1, 0.9)[:, None], (bad + 0.02) / (bad + 0.02).sum(1, keepdims=True) * np.where(bad.any(1), 0.9, 0.1)[:, None]], 1)
    lean = np.ones((1 + len(RULES), len(RULES), 3))
    for r in range(len(RULES)):
        lean[1 + r, r, 0] = 20
    for _ in range(rounds):
        before = post
        weight = counts[:, None] * post
        n = np.einsum("pc,prk->crk", weight, hit) + lean
        n /= n.sum(2, keepdims=True)
        n[0, :, 0] = np.minimum(n[0, :, 0], FALSE_ALARM)
        prior = (weight.sum(0) + 1) / (counts.sum() + post.shape[1])
        odds = np.log(prior) + np.einsum("prk,crk->pc", hit, np.log(n))
        odds -= odds.max(1, keepdims=True)
        post = np.exp(odds)
        post /= post.sum(1, keepdims=True)
        if np.abs(post - before).max() < 1e-9:
            break
    return {int(c): float(p) for c, p in zip(codes, post[:, 0], strict=True)}


def _patterns(docs: DataFrame) -> dict[int, float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in _text.slices(batch, "text"):
                codes, n = np.unique(pattern(votes(Counts(data, offsets).features())), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["code", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    return estimate(np.array([r.code for r in rows], np.int64), np.array([r.n for r in rows], float))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Base counts, posterior quality and verdict of every row of docs(doc_id, text)."""
    _tables.bounded_batches(docs.sparkSession)
    known = _patterns(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _text.slices(batch, "text"):
                c = Counts(data, offsets)
                post = np.array([known.get(int(k), 0.0) for k in pattern(votes(c.features()))], float)
                failed = (c.n_words < 50) | (100 * c.n_repeat_words > 50 * c.n_words)
                longs = [pa.array(x.astype(np.int64)) for x in (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(pa.int64()), *longs, pa.array(failed), pa.array(~failed & (post >= threshold)), pa.array(post)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
