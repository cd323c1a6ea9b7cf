"""Full outer match of two frames on a key, as one aggregation.

A full outer join shuffles both sides and gives each key to one task; a key
that holds a large share of the rows makes that task the job's tail, and
AQE cannot split skew in a full outer join.  Here both sides are unioned
with a side tag and grouped by the key instead: one shuffle, and map-side
partial aggregation reduces any key to one row per map task before it moves.
The result is hash-partitioned by the key, so a later join or aggregation on
the same key needs no further shuffle."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _struct_type(df: DataFrame, cols: Sequence[Column]):
    return df.select(F.struct(*cols).alias("s")).schema["s"].dataType


def outer_match(left: DataFrame, right: DataFrame, keys: Sequence[str],
                left_cols: Sequence[Column], right_cols: Sequence[Column]) -> DataFrame:
    """(keys..., ``_l``, ``_r``, ``_l_n``, ``_r_n``): per key the struct of ``left_cols``
    from the left side and of ``right_cols`` from the right side; NULL where the
    key is absent on that side.  ``_l_n`` and ``_r_n`` count the rows on each side:
    above 1 the struct is only one of several (the greatest), and callers must
    not take it for the whole."""
    return both_sides(left, right, keys, left_cols, right_cols).groupBy(*keys).agg(
        F.max("_l").alias("_l"), F.max("_r").alias("_r"), F.count("_l").alias("_l_n"), F.count("_r").alias("_r_n"))


def both_sides(left: DataFrame, right: DataFrame, keys: Sequence[str],
               left_cols: Sequence[Column], right_cols: Sequence[Column]) -> DataFrame:
    """All rows of both sides: (keys..., ``_l``, ``_r``), the struct of the other
    side NULL."""
    lt, rt = _struct_type(left, left_cols), _struct_type(right, right_cols)
    a = left.select(*keys, F.struct(*left_cols).alias("_l"), F.lit(None).cast(rt).alias("_r"))
    b = right.select(*keys, F.lit(None).cast(lt).alias("_l"), F.struct(*right_cols).alias("_r"))
    return a.unionByName(b)
