"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over the threshold, reassemble by position.

DataFrame functions only. A line's key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z in lower case; two
64-bit hashes with different seeds stand for it. Shuffled are hashes and positions; texts move once, when drops are joined.

Hot lines: the first shuffle deals (hash, document) pairs, the second one merges counts map-side, and the join against the
repeated keys has an exchange on both sides, which adaptive execution splits when one key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Scratch, ascii_lower

MIN_CHARS, MIN_DOCS = 10, 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, tag (which text of that doc), pos and the key's hashes h1, h2 of each line that counts."""
    lines = docs.select(F.col("doc_id").alias("doc"), F.hash("text").alias("tag"), F.posexplode(_lines(F.col("text"))).alias("pos", "line")).where("doc is not null")
    keyed = lines.select("doc", "tag", "pos", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= min_chars)
    return keyed.select("doc", "tag", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the repeated lines gone from text, plus n_lines (before) and n_dropped, which replace columns of those names.

    Keys of min_chars code points or more found in min_docs documents or more lose all their lines but those in the smallest
    doc_id that has the key (there every copy stays). Null text counts as one empty line and comes back empty. A row whose
    doc_id is null keeps all its lines and isn't counted. Rows that share a doc_id count as one document. Very long texts are
    split whole. An empty table gives an empty table. Other columns pass through.
    """
    scratch = Scratch(docs.sparkSession, "linededup")
    seen = scratch.cut(_occurrences(docs, min_chars), "zstd")  # read twice; lines are split and hashed once
    per_doc = seen.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    repeated = per_doc.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("keeper")).where(F.col("n") >= min_docs)
    repeated = scratch.cut(repeated.select("h1", "h2", "keeper"))
    drops = (
        seen.join(repeated, ["h1", "h2"]).where("doc <> keeper").groupBy("doc", "tag")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
        .select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("gone").alias("__gone"))
    )
    joined = docs.join(drops, (docs["doc_id"] == drops["__doc"]) & (F.hash(docs["text"]) == drops["__tag"]), "left")
    # an array with true at each dropped position: its elements are found in constant time
    gap = lambda x, i: x - F.coalesce(F.get(F.col("__gone"), i - 1), F.lit(-1)) - 1
    flags = F.flatten(F.transform("__gone", lambda x, i: F.concat(F.array_repeat(F.lit(False), gap(x, i)), F.array(F.lit(True)))))
    joined = joined.select("*", F.inline(F.array(F.struct(_lines(F.col("text")).alias("__lines"), flags.alias("__flags")))))  # computed once
    kept = F.array_join(F.filter("__lines", lambda x, i: ~F.coalesce(F.get(F.col("__flags"), i), F.lit(False))), "\n")
    out = joined.withColumns({
        "text": F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept),
        "n_lines": F.size("__lines").cast("long"),
        "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
    })
    return out.drop("__doc", "__tag", "__gone", "__lines", "__flags")
