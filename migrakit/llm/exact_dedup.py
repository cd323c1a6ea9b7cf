"""Exact dedup by distributed MSD radix partitioning.

Texts (without white space) are split by their leading bytes, the groups by the
next bytes, and so on until a group is a single document or its documents have
ended; documents that end in one group are equal.  Equality needs no digest.

A digit is a run of successive bytes.  Its width grows with the depth (64
bytes, then 8 times more each round, ``max_digit`` at most), so texts that differ
early cost one small digit, and a text of L bytes is split in about log8(L)
rounds plus L / ``max_digit``.  The padding of a digit past the end of a text is
told apart by the text's length, which is part of the first digit.

One round: documents still in doubt are counted by (group, digit) with partial
aggregation, so a group of copies with a third of all rows is one row per task;
the counted groups are checkpointed, and the join that hands documents their
new group is between two plain shuffles, which AQE splits.  Only the digits of
documents still in doubt are moved: after the first round, copies and near
copies.  Texts are written once, without white space, to the shared folder, and
those in doubt after the first round once more; digits are read from there.

Defined results: a null text counts as empty; empty texts are equal; of equal
texts the one with the most code points before white space was deleted, then
the smallest doc_id (null last), stays; repeated rows are members like others
and one of them stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_spaces, packed_columns, settled, whole_text, written

#: At most so many row names (8 bytes each) are broadcast; more are shuffled.
BROADCAST_ROWS = 500_000


def _spread_over_groups(active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: (rid, gid) of the documents that share their group and digit
    with another one."""
    groups = settled(active.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("next"))
                     .where(F.col("n") > 1).drop("n"))
    return active.join(groups, ["gid", "digit"]).select("rid", "bytes", F.col("next").alias("gid"))


def equal_groups(docs: DataFrame, first_digit: int = 64, max_digit: int = 1 << 20,
                 keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, members): ``rows`` (row, rid, n_chars, bytes, text_sha256, norm) of every document, written
    once; ``members`` (rid, gid) of the documents that equal another one."""
    norm = F.encode(drop_spaces(whole_text("text")), "UTF-8")
    rows = written(docs.select(packed_columns(docs, keep), F.monotonically_increasing_id().alias("rid"),
                               F.char_length(whole_text("text")).cast("long").alias("n_chars"), norm.alias("norm"))
                   .withColumn("bytes", F.octet_length("norm"))
                   .withColumn("text_sha256", F.sha2("norm", 256)), "exact")
    # The length goes first: past it, groups hold texts of one length, which end together.
    active = rows.select("rid", "bytes", F.lit(-1).cast("long").alias("gid"),
                         F.concat(F.encode(F.col("bytes").cast("string"), "UTF-8"), F.unhex(F.lit("FF")),
                                  F.substring("norm", 1, first_digit)).alias("digit"))
    active = settled(_spread_over_groups(active))
    at, width, ended, texts = first_digit, first_digit, [], None
    while True:
        ended.append(active.where(F.col("bytes") <= at).select("rid", "gid"))
        active = active.where(F.col("bytes") > at)
        left = active.count()
        if not left:
            break
        if texts is None:       # from here on only the texts still in doubt are read
            rids = active.select("rid")
            texts = written(rows.select("rid", "norm").join(
                F.broadcast(rids) if left <= BROADCAST_ROWS else rids, "rid", "left_semi"), "exact-doubt")
        width = min(8 * width, max_digit)
        digits = texts.select("rid", F.substring("norm", at + 1, width).alias("digit"))
        active = settled(_spread_over_groups(active.join(digits, "rid")))
        at += width
    members = ended[0]
    for e in ended[1:]:
        members = members.union(e)
    return rows, members


def exact_dedup(docs: DataFrame, keep: list[str] | None = None, **digits) -> DataFrame:
    """(row, rid, keep_id, group_size, kept, text_sha256) of every document;
    ``row`` holds the columns ``keep`` (default all, text included)."""
    rows, members = equal_groups(docs, keep=keep, **digits)
    slim = rows.select("row", "rid", F.col("row.doc_id").alias("doc_id"), "n_chars", "text_sha256")
    ranked = slim.select("rid", "doc_id", "n_chars").join(members, "rid")
    stay = settled(ranked.groupBy("gid").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first"))
        .select("gid", "group_size", F.col("first.rid").alias("keep_rid"), F.col("first.doc_id").alias("keep_id")))
    told = members.join(stay, "gid").select("rid", "group_size", "keep_rid", "keep_id")
    alone = F.col("keep_rid").isNull()
    return (slim.join(told, "rid", "left")
            .select("row", "rid", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"), "text_sha256"))
