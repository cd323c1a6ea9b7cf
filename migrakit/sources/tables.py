"""Table sources: references to tables, full scans (S1), row counts (S2),
frames from records with a declared schema (S3) and balanced unions (U1)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from ..functions.strings import quote_ident

# Providers that can be copied file for file in the same format.
SAME_FORMAT_PROVIDERS = ("delta", "iceberg", "parquet")

COUNT_SCHEMA = "database string, table_name string, n long"
#: Formats whose footers hold row counts.
FOOTER_FORMATS = ("parquet", "orc")
#: Tables counted by one plan, and the bytes of files whose footers one task reads.
COUNT_BLOCK, FOOTER_BYTES = 64, "8g"
#: Characters of an error that a row keeps.
ERROR_CHARS = 2000


@dataclass(frozen=True)
class TableRef:
    """A table by catalog name or by (provider, location).

    ``name`` wins when set (``spark.table``); otherwise the files at
    ``location`` are read with ``provider``.
    """

    database: str
    table: str
    provider: str | None = "parquet"
    location: str | None = None
    partition_columns: tuple[str, ...] = field(default_factory=tuple)
    name: str | None = None
    options: tuple[tuple[str, str], ...] = field(default_factory=tuple)

    def at(self, location: str, provider: str | None = None, name: str | None = None) -> "TableRef":
        return replace(self, location=location, provider=provider or self.provider, name=name)


def records(spark: SparkSession, rows: Sequence, schema: StructType | str) -> DataFrame:
    """S3: rows plus a declared schema; never inferred, so no rows is fine.

    Built through Arrow, the rows become a local relation in the plan (no
    RDD, no tasks to read them back); a type Arrow cannot carry falls back to
    Spark's row conversion."""
    rows = list(rows)
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    try:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow_schema = to_arrow_schema(st)
        table = pa.Table.from_pylist([dict(zip(st.fieldNames(), r)) for r in rows], schema=arrow_schema)
        return spark.createDataFrame(table, st)
    except Exception:  # noqa: BLE001 - any type Arrow cannot carry
        return spark.createDataFrame(rows, schema=st)


def read_table(spark: SparkSession, ref: TableRef, schema: StructType | None = None) -> DataFrame:
    """All rows and columns of a table.  Raises when it cannot be resolved."""
    if ref.name:
        return spark.table(ref.name)
    reader = spark.read
    if ref.provider:
        reader = reader.format(ref.provider)
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in ref.options:
        reader = reader.option(k, v)
    return reader.load(ref.location)


def partition_columns(spark: SparkSession, ref: TableRef) -> tuple[str, ...]:
    """Partition columns of a table: given ones, else from the catalog."""
    if ref.partition_columns or not ref.name:
        return tuple(ref.partition_columns)
    return tuple(c.name for c in spark.catalog.listColumns(ref.name) if c.isPartition)


def union_all(frames: Sequence[DataFrame], allow_missing: bool = True) -> DataFrame:
    """Union by name as a balanced tree (plan depth log2(n), not n).

    Columns missing from some inputs become NULL there."""
    frames = list(frames)
    if not frames:
        raise ValueError("union_all needs at least one frame")
    while len(frames) > 1:
        nxt = []
        for i in range(0, len(frames) - 1, 2):
            nxt.append(frames[i].unionByName(frames[i + 1], allowMissingColumns=allow_missing))
        if len(frames) % 2:
            nxt.append(frames[-1])
        frames = nxt
    return frames[0]


def size_hint(spark: SparkSession, ref: TableRef) -> int:
    """Bytes under a table's location (one file-system call); 0 when unknown
    (a catalog name without a location, or an unreadable path)."""
    if not ref.location:
        return 0
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(ref.location)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return int(fs.getContentSummary(path).getLength())
    except Exception:  # noqa: BLE001
        return 0


def largest_first(spark: SparkSession, items: Sequence, ref_of=lambda x: x) -> list:
    """Items ordered by the size of their table, largest first, so that in a
    pool of concurrent jobs the biggest table never starts last."""
    items = list(items)
    sizes = [size_hint(spark, ref_of(i)) for i in items]
    return [i for _, i in sorted(zip(sizes, items), key=lambda p: -p[0])]


def read_tables(spark: SparkSession, refs: Sequence[TableRef], schemas: dict | None = None,
                max_workers: int = 8) -> list:
    """Resolve many tables at once: a DataFrame per ref, or the exception
    when it cannot be resolved.  Resolving is driver work (file listing,
    footer or catalog lookups) and is done from a small thread pool, so its
    cost grows with the number of tables divided by the pool size."""
    schemas = schemas or {}

    def one(ref):
        try:
            return read_table(spark, ref, schemas.get((ref.database, ref.table)))
        except Exception as e:  # noqa: BLE001
            return e

    refs = list(refs)
    if len(refs) <= 1:
        return [one(r) for r in refs]
    with ThreadPoolExecutor(max_workers=min(max_workers, len(refs))) as pool:
        return list(pool.map(one, refs))


def _count_frame(ref: TableRef, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(ref.database).alias("database"), F.lit(ref.table).alias("table_name"), "n")


def reason(error: BaseException) -> str:
    """The first characters of an error without its stack frames, with its class where the
    text does not begin with one."""
    text = "\n".join(line for line in str(error).strip().splitlines() if not line.lstrip().startswith(("at ", "... ")))
    return (text if text.startswith("[") else f"{type(error).__name__}: {text}")[:ERROR_CHARS]


def footer_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` that answers counts of files from their
    footers alone: one row per file reaches the aggregation, no batch of rows."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if value is not None and (not key.startswith("spark.") or own.conf.isModifiable(key)):
            own.conf.set(key, value)
    lists = own.conf.get("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in lists.split(",") if x not in FOOTER_FORMATS))
    for fmt in FOOTER_FORMATS:
        own.conf.set(f"spark.sql.{fmt}.aggregatePushdown", "true")
    own.conf.set("spark.sql.files.maxPartitionBytes", FOOTER_BYTES)
    return own


def _footer_counts(spark: SparkSession, refs: Sequence[TableRef], max_workers: int) -> dict[int, int]:
    """Row counts by place in ``refs``, of the tables whose footers tell them.  A table
    missing here is counted, or its error told, by a job of its own."""
    own = footer_session(spark)
    held = [i for i, r in enumerate(refs) if not r.name and r.location and (r.provider or "").lower() in FOOTER_FORMATS]
    frames = [(i, df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n"))
              for i, df in zip(held, read_tables(own, [refs[i] for i in held], max_workers=max_workers))
              if not isinstance(df, Exception)]

    def block(part):
        try:
            # A pushed-down count is a sum over files: NULL, which its type does not admit, where no file has a row group.
            return [(r["i"], r["n"] or 0) for r in union_all([f for _, f in part]).collect()]
        except Exception:  # noqa: BLE001 - some table of the block cannot be read
            half = len(part) // 2
            return block(part[:half]) + block(part[half:]) if half else []

    with ThreadPoolExecutor(max_workers=max_workers) as pool:
        parts = pool.map(block, [frames[k:k + COUNT_BLOCK] for k in range(0, len(frames), COUNT_BLOCK)])
        return dict(row for part in parts for row in part)


def count_tables(spark: SparkSession, refs: Iterable[TableRef], isolate: bool = True,
                 max_workers: int = 8, reasons: bool = False) -> DataFrame:
    """One row (database, table_name, n) per table; n is NULL when the
    table cannot be read -- whether it fails to resolve or fails while read.
    ``reasons`` adds ``error``, why a count is NULL (NULL for a table that was counted).

    Default: Parquet and ORC tables by location are counted from their footers,
    ``COUNT_BLOCK`` tables a plan; a plan that fails is halved until the table that
    fails it stands alone.  Other tables (by name, other formats) are one job
    each; jobs are submitted from a driver pool, which receives one row per table.
    ``isolate=False`` builds one lazy plan with the counts of all tables unioned
    instead (then a failure while reading fails the whole plan).
    """
    refs = list(refs)
    if isolate:
        found = {} if not refs else _footer_counts(spark, refs, max_workers)

        def one(i):
            if i in found:
                return (refs[i].database, refs[i].table, found[i], None)
            try:
                return (refs[i].database, refs[i].table, _count_frame(refs[i], read_table(spark, refs[i])).first()["n"], None)
            except Exception as e:  # noqa: BLE001 - any failure is an unreadable table
                return (refs[i].database, refs[i].table, None, reason(e))

        with ThreadPoolExecutor(max_workers=max_workers) as pool:
            rows = list(pool.map(one, range(len(refs))))
        counts = records(spark, rows, COUNT_SCHEMA + ", error string")
        return counts if reasons else counts.drop("error")

    frames, unreadable = [], []
    for ref, df in zip(refs, read_tables(spark, refs)):
        if isinstance(df, Exception):
            unreadable.append((ref.database, ref.table, None, reason(df)))
        else:
            frames.append(_count_frame(ref, df).withColumn("error", F.lit(None).cast("string")))
    if unreadable or not frames:
        frames.append(records(spark, unreadable, COUNT_SCHEMA + ", error string"))
    counts = union_all(frames)
    return counts if reasons else counts.drop("error")


def hashable(c: Column, kind: DataType) -> Column:
    """A value in a form whose hash tells NULLs, places and map contents apart.

    Hash functions skip NULLs, so every field and element carries a NULL flag; a
    map, which has no hash, becomes its entries in sorted order; a variant its
    JSON text.  The same at any depth."""
    def flagged(x: Column, t: DataType) -> Column:
        return F.struct(x.isNull().alias("n"), hashable(x, t).alias("v"))

    if isinstance(kind, MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(
            hashable(e["key"], kind.keyType).alias("k"), flagged(e["value"], kind.valueType).alias("v"))))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: flagged(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.struct(*[flagged(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)])
    if isinstance(kind, VariantType):
        return F.to_json(c)
    return c


def fingerprint_exprs(schema: StructType) -> list:
    """(n, content_hash) aggregate expressions over the fields of ``schema``, in order.

    The hash is the exact (decimal) sum of a 64-bit hash of every row, so
    duplicates count and no overflow occurs at any table size.  Every column
    enters with a NULL flag, so a value moved across a NULL changes it."""
    h = row_hash(schema).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("n"), F.sum(h).alias("content_hash")]


def row_hash(schema: StructType) -> Column:
    """64-bit hash of a row over the fields of ``schema``, in order, each with a NULL flag."""
    parts = []
    for f in schema.fields:
        c = F.col(quote_ident(f.name))
        parts += [c.isNull(), hashable(c, f.dataType)]
    return F.xxhash64(*parts)


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and an order-free content hash of a frame (one row)."""
    fields = [df.schema[c] for c in columns] if columns else df.schema.fields
    return df.agg(*fingerprint_exprs(StructType(fields)))
