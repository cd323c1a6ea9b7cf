"""Line dedup: a line that many documents share stays in one of them.

Lines are exploded, normalised and hashed; per hash the documents that hold it
are counted, lines of hashes over the threshold are dropped everywhere but in
the smallest doc_id, and documents are put together again by line position.
Only hashes and positions are shuffled by line; each text moves once, to meet
the positions that its document loses.

A line's hash is two 64-bit hashes with different seeds (128 bits): at 10^12
distinct lines the chance of any collision is about 10^-15.

Hot lines: a line that a third of all rows share is one row per task after
partial aggregation; the join that finds its other holders is between two
plain shuffles (the counted hashes are checkpointed first), which AQE splits.

Defined results: a null or empty text is one empty line; a document is a
doc_id, so repeated rows of one doc_id are one document and keep or lose the
same lines; rows without doc_id are one document, sorted last; an empty table
gives no rows; other columns of the caller are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fold_ascii, outside, packed, row_key, settled, whole_text


def line_key(line: Column) -> Column:
    return fold_ascii(F.trim(line, F.lit(SPACES)))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(row, text, n_lines, n_dropped): ``row`` holds all columns of ``docs``,
    ``text`` what is left of it.  Keys of at least ``min_chars`` code points in
    at least ``min_docs`` documents lose their lines outside the smallest doc_id."""
    base = packed(docs).select("row", row_key(F.col("row.doc_id"), F.col("row.text")).alias("rk"),
                               F.col("row.doc_id").alias("doc_id"), whole_text("row.text").alias("text"))
    lines = (base.select("rk", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
             .withColumn("key", line_key(F.col("line")))
             .where(F.char_length("key") >= min_chars)
             .select("rk", "doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")))
    no_id = F.col("doc_id").isNull()
    if min_docs <= 2:
        held = (lines.groupBy("h1", "h2")
                .agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last"), F.max(no_id).alias("any_null"))
                .where((F.col("keep") != F.col("last")) | (F.col("keep").isNotNull() & F.col("any_null"))))
    else:
        held = (lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2")
                .agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs))
    held = settled(held.select("h1", "h2", "keep"))
    # Checkpointed, so that the join with the texts is between two plain shuffles too.
    lost = (lines.join(held, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keep")))
            .groupBy("rk").agg(F.sort_array(F.collect_set("pos")).alias("lost")))
    lost = settled(lost)
    spans = F.transform("lost", lambda p: F.struct(p.alias("begin"), (p + 1).alias("end")))
    kept = F.array_join(outside(F.split("text", "\n", -1), spans), "\n")
    newlines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return (base.join(lost, "rk", "left")
            .select("row", F.when(F.col("lost").isNull(), F.col("text")).otherwise(kept).alias("text"),
                    (newlines + 1).cast("long").alias("n_lines"),
                    F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped")))
