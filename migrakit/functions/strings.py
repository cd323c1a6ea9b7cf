"""String column helpers, all built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounded_text(c: Column, limit: int = 32000) -> Column:
    """The first ``limit`` characters."""
    return F.substring(c, 1, limit)


def basename(c: Column, sep: str = "/") -> Column:
    """Last part of a path (``split(sep)[-1]``)."""
    return F.substring_index(c, sep, -1)


def join_path(base: str, name: Column) -> Column:
    """``base.rstrip('/') + '/' + name``."""
    return F.concat(F.lit(base.rstrip("/")), F.lit("/"), name)


def is_blank(value: str | None) -> bool:
    return value is None or value.strip() == ""


def quote_ident(name: str) -> str:
    """Back-quote one identifier part, doubling back-quotes inside it."""
    return "`" + name.replace("`", "``") + "`"


def quote_name(*parts: str) -> str:
    return ".".join(quote_ident(p) for p in parts)


def quote_ident_col(c: Column) -> Column:
    """``quote_ident`` as a column expression."""
    return F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))
