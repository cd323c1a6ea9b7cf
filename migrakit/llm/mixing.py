"""Mixing sources to target weights over a training curriculum.

Every source has a share of the token budget (``targets``) and a schedule: a
piecewise-linear rate over training time 0..1.  The rate is integrated to a
cumulative token demand; a document's place in its source's token stream is
put through the inverse of that demand, which is its training position.  A
source smaller than its target is read again (``max_repeat`` passes at most),
so one document can have several positions.

How it runs: the place in the stream is a prefix sum over documents in the
order of md5(doc_id, text).  Documents fall into 4,096 ranges of that order per
source; range totals are pre-aggregated and summed up per source, and a window
runs only inside one range, so a source with a third of all rows is spread
over 4,096 groups.  No Python runs on the executors.

Defined results: a null text has size 0; a null source is a source of its own,
sorted last; rows of one doc_id and text are ordered by size and so
interchangeable; an empty table gives no rows; a source of size 0 has target
0 and none of its documents is taken; the caller's columns travel in a struct,
so names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, settled, whole_text, word_count

#: Hex digits of the md5 that name a range: 16^3 ranges per source.
RANGE_DIGITS = 3


def _source_key(c: Column) -> Column:
    """A non-null join key that keeps null apart from every string."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c))


def sized(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, skey, size, h, bucket) of every row."""
    h = F.md5(F.concat(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.lit(":"), whole_text("row.text")).cast("binary"))
    return (packed(docs)
            .select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").cast("string").alias("source"),
                    word_count(whole_text("row.text")).alias("size"), h.alias("h"))
            .withColumn("skey", _source_key(F.col("source")))
            .withColumn("bucket", F.substring("h", 1, RANGE_DIGITS)))


def cycle_weights(sources: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Weight ``cycle`` over the sources by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]),
                                                     (rank % len(cycle) + 1).cast("int")))


def targets(sources: DataFrame, max_repeat: int = 3) -> DataFrame:
    """(source, skey, source_size, weight) -> + target: the budget is the sum
    of all sizes, shared by weight, a source capped at ``max_repeat`` times its
    size and what exceeds a cap shared again by weight.

    Closed form: sources in the order of cap / weight fill up first, so the
    level per unit of weight is that of the first source left unfilled.  One
    row per source; the windows run over sources, never over documents.
    """
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    zero = F.lit(0.0)
    return (sources
            .withColumn("cap", F.col("source_size").cast("double") * float(max_repeat))
            .withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everywhere)
                                  - F.coalesce(F.sum("cap").over(before), zero))
                        / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), zero)))
            .withColumn("place", F.row_number().over(order))
            .withColumn("filled", F.col("cap") <= F.col("level") * F.col("weight"))
            .withColumn("level", F.min_by("level", F.when(~F.col("filled"), F.col("place"))).over(everywhere))
            .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
            .drop("cap", "level", "place", "filled"))


def weight_ramps(sources: DataFrame, slope: float = 0.5) -> DataFrame:
    """The default curriculum: lighter sources fade out, heavier ones fade in.
    Knots (skey, t, rate) of a line from 1 + d to 1 - d, d = slope * (2 - weight),
    limited to rates of at least 0; its integral is 1."""
    d = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.lit(float(slope)) * (F.lit(2.0) - F.col("weight"))))
    return sources.select("skey", F.explode(F.array(
        F.struct(F.lit(0.0).alias("t"), (F.lit(1.0) + d).alias("rate")),
        F.struct(F.lit(1.0).alias("t"), (F.lit(1.0) - d).alias("rate")))).alias("k")).select("skey", "k.t", "k.rate")


def demand(knots: DataFrame) -> DataFrame:
    """Integrate (skey, t, rate) knots: one row per source with its line
    segments (t0, r0, a = slope of the rate, c0 = demand before t0) and the
    whole integral.  Knots are a setting: a few per source."""
    w = Window.partitionBy("skey").orderBy("t")
    seg = (knots.withColumn("t1", F.lead("t").over(w)).withColumn("r1", F.lead("rate").over(w))
           .where(F.col("t1") > F.col("t"))
           .withColumn("area", (F.col("rate") + F.col("r1")) / 2.0 * (F.col("t1") - F.col("t")))
           .withColumn("c0", F.sum("area").over(w) - F.col("area")))
    return seg.groupBy("skey").agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("c0"), F.col("t").alias("t0"), F.col("rate").alias("r0"),
            ((F.col("r1") - F.col("rate")) / (F.col("t1") - F.col("t"))).alias("a")))).alias("segments"),
        F.sum("area").alias("whole"))


def invert(segments: Column, demanded: Column) -> Column:
    """Training time at which ``demanded`` (in units of the integral) is
    reached: the root of r0*x + a*x*x/2 = rest inside the last segment that
    begins at or below it."""
    s = F.element_at(F.filter(segments, lambda g: g["c0"] <= demanded), -1)
    rest = demanded - s["c0"]
    root = s["r0"] + F.sqrt(F.greatest(F.lit(0.0), s["r0"] * s["r0"] + s["a"] * 2.0 * rest))
    return s["t0"] + F.when(root > 0, rest * 2.0 / root).otherwise(F.lit(0.0))


def mix(docs: DataFrame, weights: DataFrame | None = None, knots: DataFrame | None = None,
        max_repeat: int = 3) -> DataFrame:
    """One row per document: (row, doc_id, source, size, source_size, target,
    copies, positions).

    ``weights``: (source, weight); default 1, 2, 3 in turn; a source without a
    weight above 0 has target 0.  ``knots``: (source,
    t, rate); default ``weight_ramps``.  Copy k of a document stands at
    k * source_size + its prefix sum in the source's stream and is taken while its
    middle lies below the target, so what a source gives is within half a
    document of its target.
    """
    rows = sized(docs)
    # At most 4,096 rows per source, read several times below: kept, not computed again.
    totals = settled(rows.groupBy("skey", "bucket").agg(F.sum("size").alias("n")))
    sources = totals.groupBy("skey").agg(F.sum("n").alias("source_size")).withColumn(
        "source", F.when(F.col("skey") != "", F.expr("substring(skey, 2)")))
    if weights is None:
        sources = cycle_weights(sources)
    else:
        given = weights.select(_source_key(F.col("source").cast("string")).alias("skey"),
                               F.col("weight").cast("double").alias("weight"))
        sources = sources.join(given, "skey", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        sources = sources.where(F.col("weight") > 0)
    planned = targets(sources, max_repeat)
    lines = (weight_ramps(planned) if knots is None else
             knots.select(_source_key(F.col("source").cast("string")).alias("skey"), F.col("t").cast("double").alias("t"),
                          F.col("rate").cast("double").alias("rate")))
    planned = planned.join(demand(lines), "skey").drop("source")
    by_range = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (totals.select("skey", "bucket", F.coalesce(F.sum("n").over(by_range), F.lit(0)).alias("start"))
              .join(planned, "skey"))
    inside = (Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.join(ranges, ["skey", "bucket"], "left")
              .withColumn("target", F.coalesce("target", F.lit(0.0)))
              .withColumn("start", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))))
    middle = lambda k: k.cast("double") * F.col("source_size") + F.col("start") + F.col("size") / 2.0
    taken = F.filter(F.sequence(F.lit(0), F.lit(max_repeat - 1)), lambda k: middle(k) < F.col("target"))
    at = lambda k: invert(F.col("segments"), middle(k) / F.col("target") * F.col("whole"))
    return placed.select("row", "doc_id", "source", "size", "source_size", "target",
                         F.size(taken).alias("copies"), F.transform(taken, at).alias("positions"))


def training_order(mixed: DataFrame) -> DataFrame:
    """The mix itself: one row per taken copy with all of the document's
    columns, range-sorted by training position."""
    copies = mixed.where(F.col("copies") > 0).select("row", F.explode("positions").alias("position"))
    return copies.sort("position", F.col("row.doc_id")).select("row.*")
