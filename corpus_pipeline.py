"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, jaccard, linededup, packing, rules
from rasterloom.llm.common import Scratch, cleaned, table
from rasterloom.llm.queries import tokenizer_path
from rasterloom.session import ship


def _apart(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The operator's result in the columns of docs, whose further columns keep their values whatever the operator calls its own."""
    needed = {"doc_id", "text", "n_chars"}
    names = {c: c if c.lower() in needed else f"__own_{k}" for k, c in enumerate(docs.columns)}
    out = operator(docs.withColumnsRenamed(names))
    return out.select(*(F.col(n).alias(c) for c, n in names.items()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and short texts among them. Very long texts are read whole. Rows are judged
    each for itself, repeated ones and null doc_ids too; all of them train the rules' accuracies. An empty table stays empty."""
    return _apart(docs, lambda d: rules.quality_rules(d).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but for those in the smallest doc_id; n_chars, where there is one, follows the text. Null text becomes an
    empty one. Very long texts are split whole. Rows that share a doc_id count as one document, rows without one keep all lines.
    A document whose lines all go stays, empty. An empty table stays empty."""

    def dedup(d: DataFrame) -> DataFrame:
        out = linededup.line_dedup(d)
        return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in d.columns else out

    return _apart(docs, dedup)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id: links are fingerprints within op2's radius, or
    5-word Jaccard of 0.8 or more. Null and empty texts are copies of each other. Rows that share a doc_id are judged each by its
    own text, equal rows together; rows without a doc_id stay. Very long texts are read whole. An empty table stays empty."""
    ship(spark)
    return _apart(docs, jaccard.near_dedup)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go: a twentieth of their words or more in windows of 13. Null and empty texts stay, and
    so do rows without a doc_id. Rows that share a doc_id are judged each by its own text, equal rows together. Very long texts
    are judged by the same share. An empty table or benchmark drops nothing."""
    ship(spark)
    return _apart(docs, lambda d: decontaminate.decontaminate(d, table(spark, sf_dir, "benchmark")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences. Null and empty texts are the end token alone; very long texts are cut into
    pieces; each row is packed, repeated ones and null doc_ids too. An empty table gives no piece."""
    ship(spark)
    found = packing.pack(docs, tokenizer_path())
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: Fingerprints, components and token ids are beyond SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and goes when the next one is there."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with cleaned(spark):
            kept = scratch.cut(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = kept
    return docs
