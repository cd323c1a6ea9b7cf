"""Plan-shape helpers: work something out once."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_json(df: DataFrame, col: str, schema, out: str, keep: tuple[str, ...] = (),
               options: dict | None = None) -> DataFrame:
    """``from_json`` evaluated once per row, as a column later expressions
    read.  Without the generator boundary the optimizer inlines the parse into
    every field reference; inside conditional branches and higher-order
    functions those copies are not shared, so a document would be parsed once
    per field it is read from.  ``explode`` of a one-element array is a cheap
    per-row generator that the optimizer does not see through."""
    parsed: Column = F.from_json(F.col(col), schema, options or {})
    return df.select(*keep, F.explode(F.array(parsed)).alias(out))


def let(x: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(x)`` with ``x`` worked out once per row, also inside a higher-order
    function: a lambda's argument is a value, an expression used in several
    places of its body is one evaluation each."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly, in turn, for costly per-row work that follows: a small
    file is one or a few read tasks, however many rows it holds, and the largest
    row groups would keep some cores busy while others wait.  Deal out the narrow
    columns, before texts are built from them."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))
