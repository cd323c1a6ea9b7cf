"""Map edits (X8) as column expressions."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parallel import let


def repeats_keys(m: Column) -> Column:
    """Whether a map holds a key twice (a map parsed from JSON text can)."""
    keys = F.map_keys(m)
    return F.size(keys) > F.size(F.array_distinct(keys))


def last_of_each(m: Column) -> Column:
    """``m`` with the last value of every repeated key."""
    keys, values = F.reverse(F.map_keys(m)), F.reverse(F.map_values(m))
    names = F.reverse(F.array_distinct(keys))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(values, F.array_position(keys, k).cast("int"))))


def drop_keys(m: Column, keys: Sequence[str]) -> Column:
    """``m`` without ``keys`` (absent keys are fine; NULL map stays NULL)."""
    keys = list(keys)
    return F.map_filter(m, lambda k, v: ~k.isin(keys))


def set_key(m: Column, key: str, value: Column | str, value_type: str = "string") -> Column:
    """``m`` with ``key`` set to ``value``; a NULL map becomes a new map.  Of
    another key that ``m`` holds twice the last value stays."""
    v = value if isinstance(value, Column) else F.lit(value)
    empty = F.create_map().cast(f"map<string,{value_type}>")

    def put(kept: Column) -> Column:
        single = F.when(repeats_keys(kept), last_of_each(kept)).otherwise(kept)
        return F.map_concat(single, F.create_map(F.lit(key), v.cast(value_type)))

    return let(F.map_filter(F.coalesce(m, empty), lambda k, _: k != key), put)
