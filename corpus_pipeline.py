"""From raw documents to token ids: quality, line dedup, near-dedup, decontamination, encoding.

``STAGES`` lists the stages in order.  Each takes the documents that its predecessor
kept; all but the last return the columns of ``documents``, with ``n_chars`` counted
anew where a stage changes texts.  An empty table passes through as an empty table.  Line
dedup turns a null text into an empty one.  Further columns stay, whatever their names.
Scratch tables of a stage, and what the stage before it kept, are deleted when its own
rows are written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.llm import bpe, linededup, neardup, posindex, quality
from haulframe.llm.common import bounded, by_row, table
from haulframe.sources.scratch import drop_paths, materialize, scratch_section


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten documents or more share."""
    done = linededup.drop_shared_lines(docs)
    changed = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return done.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the smallest id.

    Rows without an id stay.  Of several rows of a class under that id, repeated or alike,
    one stays; texts under one id that are not alike are of different classes.
    """
    rows = materialize(neardup.classed_rows(docs))
    key = F.struct("k1", "k2")
    lent = rows.where("doc_id = class_id")
    several = lent.groupBy("component").agg(F.min(key).alias("kept"), F.count("*").alias("n"))
    several = bounded(several.where("n > 1").select("component", "kept"))
    alike = materialize(lent.join(several, "component").select(
        "k1", "k2", (key == F.col("kept")).alias("kept")))
    gone = rows.where("doc_id <> class_id").select("k1", "k2").union(
        alike.where("not kept").select("k1", "k2"))
    kept = by_row(docs, "doc_id", "text", bounded(gone.distinct()), "left_anti")
    twice = bounded(alike.where("kept").groupBy("k1", "k2").agg(F.count("*").alias("n"))
                    .where("n > 1").select("k1", "k2"))
    once = by_row(kept, "doc_id", "text", twice, "left_anti")
    rest = by_row(kept, "doc_id", "text", twice, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(rest).select(*_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark passage."""
    marked = posindex.contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(~F.col("contaminated")).select(*_columns(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of token ids and digests of the ids and of the decoded text."""
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("byte_bpe", encoding),
]
#: The classifier and the tokenizer have no SQL form; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over all that its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for _, stage in STAGES[:-1]:
        with scratch_section() as made:
            docs = materialize(stage(spark, docs, sf_dir))
        # the rows themselves were written last
        drop_paths(spark, [*before, *made[:-1]])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
