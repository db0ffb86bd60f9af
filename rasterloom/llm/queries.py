"""The thin queries op1 to op10 and pipeline: digest columns over whole tables, from the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import decontaminate, html, linededup, lm, packing, quality, rules, secrets, simhash, suffixdedup
from .common import digest_of, table

WORD_TOKENIZER = "word_bpe_49k.json"
#: Places that a word of a proximity match may be off.
NEAR = 1


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"), slop=NEAR)
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), digest_of(names).alias("items_sha256"), "contaminated", F.size("near_ids").cast("long").alias("n_near"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"), learn=_remainder(3) != 1)
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.suffix_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text")).withColumn("s", F.arrays_zip("kinds", "starts", "ends"))
    name = lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])
    n = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    base = F.transform(F.filter("s", lambda s: s["kinds"] != "model"), name)
    return found.select("doc_id", n("assign"), n("access"), n("hex"), digest_of(base).alias("base_sha256"), F.array_join(F.transform("s", name), ",").alias("spans"), n("model"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents", "doc_id", "text"), _remainder(7) != 2)
    return found.withColumn("held_out", _remainder(7) == 2)


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality_report(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 4).alias("p_good"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_decontaminate, op2_simhash, op3_pack, op4_line_dedup, op5_quality, op6_suffix_dedup, op7_secrets, op8_lm_score, op9_extract, op10_quality_rules]
    return {q.__name__: _shipped(q) for q in own}
