"""License scans.

Aho-Corasick automata find notice phrases over a text's words and identifier
tags over the text itself; the expression after a tag, up to the end of its
line, is read by a shunting-yard parser of and, or and with.  Operands are
licences of a known family and identifiers with a version; a word that is
neither ends the expression before its operator, so prose behind an identifier
is not read as one.

Null text counts as empty.  A document without evidence has no labels, null
first_word and last_word, and score 0.  Very long texts are scanned whole, in
batches of bounded bytes; an empty table gives no rows.  Rows are independent
of each other, so repeated rows, ties and null ids need no care; other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _tables

#: Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The method's own phrases, over words as they are after splitting.
MORE_PHRASES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "all rights reserved": "proprietary",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
}
#: How freely text under a licence may be used, from 0 to 1; ids not listed count as UNKNOWN.
OPENNESS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0,
    "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "proprietary": 0.05,
}
UNKNOWN = 0.5
#: What an exception (`with`) adds.
EXCEPTION = 0.1
#: Tags that a licence expression follows, in lower case.
TAGS = ("spdx-license-identifier:", "license-expression:")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_SPLIT = bytes(c if chr(c).isascii() and (chr(c).isdigit() or chr(c).islower()) or c > 127 else 32 for c in range(256))
_TOKEN = re.compile(rb"[()\n]|[a-z0-9][a-z0-9.+-]*")
_FAMILIES = ("cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by", "cc0", "agpl", "lgpl", "gpl", "apache", "mit", "mpl", "epl", "bsd", "isc", "bsl", "unlicense")


def family(identifier: str) -> str:
    """apache-2.0 -> apache; an unknown identifier stays as it is."""
    return next((f for f in _FAMILIES if identifier == f or identifier.startswith(f + "-")), identifier)


def known(identifier: str, after: str = "") -> bool:
    """Whether a word names a licence, or behind `with` an exception."""
    return family(identifier) in OPENNESS or bool(re.search(r"-v?[0-9]", identifier)) or after == "with" and "exception" in identifier


def evaluate(expression: bytes, at: int = 0) -> tuple[set[str], float] | None:
    """Labels and openness of the lower-case licence expression from `at` on; None if there is none on that line.

    Shunting-yard with precedence with > and > or.  `or` gives the freer side,
    `and` the stricter one, `with` adds a little for its exception.  A broken
    rest of the line ends the expression where it last was complete.
    """
    labels: set[str] = set()
    values: list[float] = []
    operators: list[str] = []

    def reduce() -> None:
        op = operators.pop()
        b, a = values.pop(), values.pop()
        values.append(max(a, b) if op == "or" else min(a, b) if op == "and" else min(1.0, a + EXCEPTION))

    want_operand = True
    for match in _TOKEN.finditer(expression, at):
        token = match[0].decode()
        if want_operand and token == "(":
            operators.append(token)
        elif want_operand and token not in _PRECEDENCE and token not in ")\n" and known(token, operators[-1] if operators else ""):
            if operators and operators[-1] == "with":
                values.append(0.0)
            else:
                labels.add(family(token))
                values.append(OPENNESS.get(family(token), UNKNOWN))
            want_operand = False
        elif not want_operand and token == ")" and "(" in operators:
            while operators[-1] != "(":
                reduce()
            operators.pop()
        elif not want_operand and token in _PRECEDENCE:
            while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= _PRECEDENCE[token]:
                reduce()
            operators.append(token)
            want_operand = True
        else:
            break
    if want_operand:
        while operators and operators[-1] == "(":
            operators.pop()
        if operators:
            operators.pop()
    operators = [o for o in operators if o != "("]
    while operators and len(values) > 1:
        reduce()
    return (labels, min(values)) if values else None


def automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in phrases.items():
        found.add_word(f" {phrase} ", (phrase, label))
    found.make_automaton()
    return found


def tag_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for tag in TAGS:
        found.add_word(tag, len(tag))
    found.make_automaton()
    return found


def scan(text: str, found: ahocorasick.Automaton, tagged: ahocorasick.Automaton, base: dict[str, str]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    parts = low.translate(_SPLIT).split()
    places: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    if parts:
        joined = (b" " + b" ".join(parts) + b" ").decode("utf-8", "surrogatepass")
        at = word = 0
        hits = sorted((end - len(phrase) - 1, phrase, label) for end, (phrase, label) in found.iter(joined))
        for start, phrase, label in hits:
            word += joined.count(" ", at, start)
            at = start
            labels.add(label)
            if phrase in base:
                places.append(word)
                base_labels.add(base[phrase])
    # A longer notice names the licence; the shorter one inside it says nothing of its own, but base labels stay.
    for longer, shorter in (("cc-by-nc", "cc-by"), ("cc-by-sa", "cc-by"), ("cc-by-nd", "cc-by")):
        if longer in labels:
            labels.discard(shorter)
    tags: list[float] = []
    plain = low.decode("utf-8", "surrogatepass")
    for end, _ in tagged.iter(plain):
        line = plain.find("\n", end)
        if got := evaluate(plain[end + 1 : line if line >= 0 else len(plain)].encode("utf-8", "surrogatepass")):
            labels |= got[0]
            tags.append(got[1])
    labels |= base_labels
    scores = tags + [OPENNESS.get(x, UNKNOWN) for x in labels if not tags]
    return len(parts), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base_labels)), ",".join(sorted(labels)), min(scores, default=0.0)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """One row per row of docs: word count, places of base phrases, labels and openness of the licences found."""
    base = BASE_PHRASES if base is None else base
    phrases = (MORE_PHRASES if more is None else more) | base
    _tables.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, tagged = automaton(phrases), tag_automaton()
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            texts = batch.column(1)
            rows = [scan(t.as_py() or "", found, tagged, base) for t in texts]
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
