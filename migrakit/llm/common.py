"""Column helpers shared by the operators of this subpackage.

Text rules used throughout: white space is ``[\\x20\\x09-\\x0D]``, case folding
touches only A-Z, a null text counts as empty unless an operator says
otherwise.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_root, work_dir

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def whole_text(col: str | Column = "text") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def fold_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else.  ``lower`` is the same rule, and
    much faster, for a text of one byte per character."""
    return (F.when(F.octet_length(c) == F.char_length(c), F.lower(c))
            .otherwise(F.translate(c, UPPER, LOWER)))


def drop_spaces(c: Column) -> Column:
    """Delete every white-space character (byte search per character: no
    regular expression, no per-character map)."""
    for ch in SPACES:
        c = F.replace(c, F.lit(ch), F.lit(""))
    return c


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def row_key(*cols: Column) -> Column:
    """16-byte digest of some columns, nulls told apart from values: joins
    rows of two branches of one frame.  Rows equal in these columns share it."""
    parts: list[Column] = []
    for c in cols:
        s = c.cast("string")
        parts += [F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.octet_length(s).cast("string"),
                                                                    F.lit(":"), s))]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def packed_columns(docs: DataFrame, keep: list[str] | None = None) -> Column:
    """All columns of ``docs`` (or those in ``keep``) inside one struct ``row``, so
    that columns an operator adds never clash with the caller's."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in keep or docs.columns]).alias("row")


def packed(docs: DataFrame) -> DataFrame:
    return docs.select(packed_columns(docs))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per Spark context: functions that
    run there are found by module name, and an executor need not have it installed."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(sc, "_migrakit_sent", False) or not package.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="migrakit-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._migrakit_sent = True


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder: its
    lineage is cut there, every executor can read it, and a join that follows
    sees two plain shuffles, so AQE can split a hot key."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read
    back: compressed, and read by column."""
    path = work_dir(df.sparkSession, "llm", name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def outside(items: Column, spans: Column) -> Column:
    """The elements of an array outside sorted, disjoint spans (struct of
    ``begin`` and ``end``, 0-based, end exclusive), in time linear in both."""
    n = F.size(items)
    begins = F.concat(F.transform(spans, lambda s: s["begin"]), F.array(n))
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    return F.flatten(F.zip_with(ends, begins, lambda e, b: F.slice(items, e + 1, F.greatest(b - e, F.lit(0)))))
