"""Sharding by bytes: contiguous shards of near-equal size.

Rows are range-sorted once into partitions that are written to the shared
folder with their running size and row number inside the partition.  The
partitions' totals (one row per partition) give every partition its offset,
so a row's global prefix sum is offset + running size, and shard k takes the
rows whose middle lies between k/S and (k+1)/S of all bytes.  No row is ever
in a task with more than its own partition; the sorted table is written
before totals are taken, so a lost executor cannot move a row to another
partition between the two steps.

Order: by default the digest of the text, then doc_id, so equal texts are
neighbours.  A cut that falls into a group of equal texts moves to the nearer
end of the group if the group is at most ``snap`` of a shard; larger groups are
cut (a group can be larger than a shard, and shards must stay equal).

Defined results: a null text has 0 bytes (size 1) and the checksum of an empty
text; equal rows are neighbours in any order; a null doc_id is first; an empty
table gives no rows; fewer rows than shards leave shards empty; the caller's
columns travel in a struct.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import packed_columns, ship, whole_text, written

_ADDED = StructType([StructField("part", IntegerType()), StructField("at", LongType()), StructField("before", LongType())])


def _running(batches):
    """Adds partition, row number and bytes before the row, for one sorted
    partition."""
    from pyspark import TaskContext

    part, at, total = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        size = b.column(b.schema.get_field_index("size"))
        after = pc.add(pc.cumulative_sum(size), pa.scalar(total, pa.int64()))
        cols = [*b.columns, pa.array([part] * b.num_rows, pa.int32()),
                pa.array(range(at, at + b.num_rows), pa.int64()), pc.subtract(after, size)]
        yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "part", "at", "before"])
        at, total = at + b.num_rows, after[-1].as_py()


def shard(docs: DataFrame, shards: int = 8, order: list[Column] | None = None, snap: float = 0.01,
          keep: list[str] | None = None) -> DataFrame:
    """(row, size, text_crc32, digest, shard, slot) of every row; ``slot`` counts
    from 0 without gaps inside a shard, in the sorted order.  ``row`` holds the
    columns ``keep`` (default: all).  ``order``: columns of ``docs`` to sort by in
    place of (digest, doc_id)."""
    ship(docs.sparkSession)
    text = F.encode(whole_text("text"), "UTF-8")
    # The last key splits even a range of equal rows over several partitions.
    place = [*(order or [F.md5(text), F.col("doc_id")]), F.monotonically_increasing_id()]
    keys = [f"place{i}" for i in range(len(place))]
    base = docs.select(packed_columns(docs, keep), *[c.alias(k) for k, c in zip(keys, place)],
                       (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
                       F.md5(text).alias("digest"))
    ordered = base.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    schema = StructType([*ordered.schema.fields, *_ADDED.fields])
    rows = written(ordered.mapInArrow(_running, schema), "shards")
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    # One row per partition from here to the cuts: the driver may hold it.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes0"),
                            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
                            F.sum("bytes").over(Window.partitionBy()).alias("total"))
    placed = (rows.join(F.broadcast(offsets), "part")
              .withColumn("before", F.col("before") + F.col("bytes0")).withColumn("at", F.col("at") + F.col("n0")))
    middle = F.col("before") + F.col("size") / 2.0
    k = F.least(F.floor(middle * F.lit(float(shards)) / F.col("total")), F.lit(shards - 1)).cast("int")
    placed = placed.withColumn("shard", k)
    if order is None and snap > 0:
        placed = _snapped(placed, shards, snap)
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))                     # one row per shard
    return (placed.join(F.broadcast(first), "shard")
            .select("row", "size", "text_crc32", "digest", "shard", (F.col("at") - F.col("first")).alias("slot")))


def _snapped(placed: DataFrame, shards: int, snap: float) -> DataFrame:
    """Moves the cuts (one fewer than shards) that split a small group of equal
    texts.  A group that a cut splits holds the first or last row of a shard."""
    ends = placed.groupBy("shard").agg(F.min_by("digest", "at").alias("a"), F.max_by("digest", "at").alias("b"))
    at_cuts = ends.select(F.explode(F.array("a", "b")).alias("digest")).distinct()      # two rows per shard at most
    groups = (placed.join(F.broadcast(at_cuts), "digest").groupBy("digest")
              .agg(F.sum("size").alias("group"), F.min("before").alias("begin"), F.first("total").alias("total")))
    middle = F.col("begin") + F.col("group") / 2.0
    whole = (groups.where(F.col("group") * F.lit(float(shards)) <= F.col("total") * F.lit(float(snap)))
             .select("digest", F.least(F.floor(middle * F.lit(float(shards)) / F.col("total")), F.lit(shards - 1))
                     .cast("int").alias("moved")))
    return (placed.join(F.broadcast(whole), "digest", "left")
            .withColumn("shard", F.coalesce("moved", "shard")).drop("moved"))
