"""Corpus pipeline: documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import _tables
from codeloom.llm.decontam import keep_clean
from codeloom.llm.line_dedup import REMOVED, cut_lines
from codeloom.llm.ngram_join import keep_one
from codeloom.llm.packing import best_fit
from codeloom.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more.

    A null or empty text is scored like any other, as a text without words.
    Scores depend on the text alone: repeated rows and ids stay or go together,
    very long texts are read whole.  Without labels every score is 0.5 and all
    stay; an empty table stays empty.  Other columns pass through.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of three lines or more; documents that have nothing left go.

    The first place by (doc_id, line) keeps a run; a null id comes last, equal
    rows are one place and lose the same lines.  Null, empty and word-less texts
    stay as they are.  n_chars follows the text.  Other columns pass through,
    whatever their names; an empty table stays empty.
    """
    removed = F.col(REMOVED)
    out = cut_lines(docs).where((removed == 0) | (F.trim("text") != ""))
    changed = lambda c: F.when(removed > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
    return out.select(*[changed(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a Jaccard similarity of 0.8 or more.

    The smallest id of a group stays; of rows with the same id and text one.
    Texts without words are linked with nothing and stay, as do rows without an
    id.  Very long texts count whole.  Other columns pass through; an empty table
    stays empty.
    """
    return keep_one(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item.

    All rows of an id go if one of them holds a window; rows without an id stay.
    Null and empty texts hold none, very long ones are searched whole.  Without
    benchmark items all stay; an empty table stays empty.  Other columns pass
    through.
    """
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences of 2048 words.

    Null, empty and word-less texts give no row, an empty table none.  A very long
    text becomes several pieces; repeated rows are copies and never share a
    sequence; a null source conflicts with nothing.  Of equally tight sequences
    the oldest is taken.
    """
    return best_fit(docs, capacity=2048)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: The classifier and the packer are iterative; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        out = _tables.stored(stage(spark, docs, sf_dir))
        if before is not None:
            _tables.dropped(before)
        docs = before = out
    return STAGES[-1][1](spark, docs, sf_dir)
