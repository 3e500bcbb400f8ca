"""Counts and features of texts, for a slice of documents at once."""

from __future__ import annotations

import numpy as np

from codeloom.llm import _text

#: Lines are runs of bytes other than \n; empty lines have no word and never count.
_LINE = np.ones(256, bool)
_LINE[10] = False

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "letter": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "bang": b"!?", "stop": b".", "comma": b",;:", "pipe": b"|", "brace": b"{}[]()=/\\_~^`@"}


def _of(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_TABLES = {k: _of(v) for k, v in _CLASSES.items()}


def keyed(doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """One sortable integer for (document, hash): the document's index in the high bits."""
    bits = np.uint64(max(1, int(docs).bit_length()))
    return (doc.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits)


def runs(doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, number of the group of each sorted place, size of each group) of equal (document, hash)."""
    key = keyed(doc, h, docs)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1
    return order, group, np.bincount(group) if len(key) else np.zeros(0, np.int64)


def covered(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of the given length that starts at one of `at`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


class Counts:
    """Counts of each document of a slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.docs = docs = len(offsets) - 1
        self.words = w = _text.words(data, offsets)
        self.doc = doc = w.doc
        self.n_words = w.counts.astype(np.int64)
        starts_char = (data & 0xC0) != 0x80
        self.sum = lambda mask: _text.per_doc_sum(mask, offsets)
        self.n_chars = self.sum(starts_char)
        self.word_chars = self.sum(starts_char & w.is_word)
        self.n_symbols = self.sum(_SYMBOLS[data])
        lines = _text.words(data, offsets, _LINE)
        inside = np.concatenate([[0], np.cumsum(w.is_word)])
        some = inside[lines.end] > inside[lines.start]
        self.line_doc = lines.doc[some]
        self.n_lines = np.bincount(self.line_doc, minlength=docs)
        _, group, size = runs(self.line_doc, lines.hashes[0][some], docs)
        order = np.sort(self.line_doc)
        first = np.ones(len(group), bool)
        first[1:] = group[1:] != group[:-1]
        self.n_dup_lines = self.n_lines - np.bincount(order[first], minlength=docs)
        end = lines.end[some]
        self.n_stopped = np.bincount(self.line_doc, weights=np.isin(data[end - 1], np.frombuffer(b'.!?"', np.uint8)) if len(end) else None, minlength=docs)
        at, h = w.grams(3)
        order, group, size = runs(doc[at], h, docs)
        again = at[order[size[group] > 1]] if len(at) else at
        self.n_repeat_words = _text.per_doc_sum(covered(again, 3, len(doc)), w.of)
        order, group, size = runs(doc, w.hashes[0], docs)
        first = np.ones(len(group), bool)
        first[1:] = group[1:] != group[:-1]
        sorted_doc = doc[order]
        self.n_distinct = np.bincount(sorted_doc[first], minlength=docs)
        self.top_word = np.zeros(docs, np.int64)
        np.maximum.at(self.top_word, sorted_doc[first], size)
        length = np.diff(np.concatenate([[0], np.cumsum(starts_char)])[np.stack([w.start, w.end])], axis=0)[0] if len(doc) else np.zeros(0, np.int64)
        self.length = length
        self.data = data

    def features(self) -> np.ndarray:
        """One row per document, in the order of NAMES."""
        w, n, c = self.words, np.maximum(self.n_words, 1), np.maximum(self.n_chars, 1)
        k = {name: self.sum(t[self.data]) for name, t in _TABLES.items()}
        short = np.bincount(self.doc, weights=self.length <= 3, minlength=self.docs)
        long = np.bincount(self.doc, weights=self.length >= 15, minlength=self.docs)
        square = np.bincount(self.doc, weights=self.length.astype(float) ** 2, minlength=self.docs)
        mean = self.word_chars / n
        first = self.data[w.start] if len(w.start) else np.zeros(0, np.uint8)
        capital = np.bincount(self.doc, weights=_TABLES["upper"][first], minlength=self.docs)
        alpha = np.bincount(self.doc, weights=_TABLES["letter"][first] | (first >= 128), minlength=self.docs)
        lines = np.maximum(self.n_lines, 1)
        return np.stack(
            [
                np.log1p(self.n_words), mean, np.sqrt(np.maximum(square / n - mean**2, 0)), self.n_symbols / c, k["upper"] / np.maximum(k["letter"], 1), k["digit"] / c, k["bang"] / n, k["stop"] / n, k["comma"] / n, k["pipe"] / n,
                k["brace"] / c, self.n_dup_lines / lines, self.n_repeat_words / n, self.n_distinct / n, self.top_word / n, short / n, long / n, capital / n, alpha / n, np.log1p(n / lines), self.n_stopped / lines, 1 - self.sum(self.data < 128) / c, 1 - self.word_chars / c,
            ],
            axis=1,
        ).astype(np.float64)


NAMES = [
    "log_words", "mean_length", "length_spread", "symbols", "upper", "digits", "bangs", "stops", "commas", "pipes",
    "braces", "dup_lines", "repeat_words", "distinct", "top_word", "short_words", "long_words", "capitals", "alphabetic", "line_words", "stopped_lines", "beyond_ascii", "white_space",
]
