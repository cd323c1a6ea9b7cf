"""Generic projections: long-to-wide attributes (P8), list size (P2),
stringify every column (P7), explode a list (J6)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def attributes_wide(df: DataFrame, keys: Sequence[str], entity: str = "entity",
                    attr: str = "attr", val: str = "val", ordinal: str = "ordinal",
                    missing: str | None = "") -> DataFrame:
    """(entity, key, value) rows -> one row per entity with one column per
    key.  On a repeated key the value with the highest ordinal wins; a key an
    entity lacks gets ``missing``.  Column names replace blanks by ``_``.

    One hash aggregation with map-side partial aggregation (each partial
    keeps one value per key), so an entity with very many rows does not land
    whole in one task."""
    aggs = []
    for k in keys:
        hit = F.col(attr) == k
        v = F.max_by(F.when(hit, F.col(val)), F.when(hit, F.col(ordinal)))
        if missing is not None:
            v = F.coalesce(v, F.lit(missing))
        aggs.append(v.alias(k.replace(" ", "_")))
    return df.groupBy(entity).agg(*aggs)


def list_size(c: Column) -> Column:
    """Number of elements as a long (NULL list -> NULL)."""
    return F.size(c).cast("long")


def with_list_size(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, F.when(F.col(col).isNotNull(), list_size(F.col(col))))


def explode_list(df: DataFrame, col: str, out: str | None = None, keep_empty: bool = False) -> DataFrame:
    """One row per list element; ``keep_empty`` keeps rows whose list is
    empty or NULL (with a NULL element)."""
    fn = F.explode_outer if keep_empty else F.explode
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, fn(F.col(col)).alias(out or col))


def stringify_col(c: Column, dtype) -> Column:
    if isinstance(dtype, (StructType, MapType, ArrayType)):
        return F.to_json(c)
    return c.cast("string")


def stringify(df: DataFrame) -> DataFrame:
    """Every column to a string; nested columns as JSON text."""
    return df.select(*[stringify_col(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
                       for f in df.schema.fields])
