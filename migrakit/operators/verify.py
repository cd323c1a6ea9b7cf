"""Check side: count verdicts (V1, J1, F4), content verdicts and the split of
an outcome frame into its good and bad part (F3, U2)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import TableRef, count_tables, read_table, read_tables, reason, records, table_fingerprint
from .merge import outer_match

KEYS = ("database", "table_name")

# Fixed verdict values.
MATCH, MISMATCH, UNKNOWN, MISSING, EXTRA = "match", "mismatch", "unknown", "missing", "extra"
DUPLICATE = "duplicate"     # a table named more than once in one check


def count_verdict(in_src: Column, in_dst: Column, a: Column, b: Column) -> Column:
    """match / mismatch on two counts; unknown when one is NULL; missing when
    the target has no row; extra when the source has no row."""
    return (F.when(in_dst.isNull(), MISSING)
             .when(in_src.isNull(), EXTRA)
             .when(a.isNull() | b.isNull(), UNKNOWN)
             .when(a == b, MATCH)
             .otherwise(MISMATCH))


def verify_counts(src: DataFrame, dst: DataFrame, keys: Sequence[str] = KEYS,
                  count_col: str = "n") -> DataFrame:
    """V1: source counts against target counts, matched on the keys so that
    a table lost on either side shows.  Output: keys, source_count,
    target_count, verdict.  NULL counts get ``unknown`` instead of being in
    neither list.

    A table may come as several count rows (e.g. one per partition or file):
    its count is their sum, NULL when any part is NULL.  Matching is one
    union + aggregation (one shuffle, map-side partial sums), so a table with
    very many count rows never lands whole in one task."""
    n = F.col(count_col).cast("long")
    none = F.lit(None).cast("long")

    def side(df: DataFrame, is_src: bool) -> DataFrame:
        return df.select(*keys, (n if is_src else none).alias("_s"), (none if is_src else n).alias("_t"),
                         F.lit(is_src).alias("_in_s"), F.lit(not is_src).alias("_in_t"),
                         (n.isNull() & F.lit(is_src)).alias("_s_null"),
                         (n.isNull() & F.lit(not is_src)).alias("_t_null"))

    g = side(src, True).unionByName(side(dst, False)).groupBy(*keys).agg(
        F.sum("_s").alias("_s"), F.sum("_t").alias("_t"), F.max("_in_s").alias("_in_s"),
        F.max("_in_t").alias("_in_t"), F.max("_s_null").alias("_s_null"), F.max("_t_null").alias("_t_null"))
    s_count = F.when(~F.col("_s_null"), F.col("_s"))
    t_count = F.when(~F.col("_t_null"), F.col("_t"))
    verdict = count_verdict(F.when(F.col("_in_s"), True), F.when(F.col("_in_t"), True), s_count, t_count)
    return g.select(*keys, s_count.alias("source_count"), t_count.alias("target_count"),
                    verdict.alias("verdict"))


def join_results(planned: DataFrame, outcomes: DataFrame, target_counts: DataFrame,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per planned table: keys, curr_loc, ext_loc,
    copied_successfully, source_count (from the plan), target_count, verdict.  A
    planned table without an outcome or a count stays, with NULLs and the verdict
    ``missing``; a copy that failed is never ``match``."""
    o = outcomes.select(*keys, "copied_successfully")
    t = target_counts.select(*keys, F.col("n").alias("target_count"), F.lit(True).alias("_counted"))
    j = planned.join(o, list(keys), "left").join(t, list(keys), "left")
    v = count_verdict(F.lit(True), F.col("_counted"), F.col("source_count"), F.col("target_count"))
    v = F.when((v == MATCH) & ~F.coalesce("copied_successfully", F.lit(False)), MISMATCH).otherwise(v)
    return j.select(*keys, "curr_loc", "ext_loc", "copied_successfully", "source_count", "target_count", v.alias("verdict"))


def split_outcomes(df: DataFrame, col: str = "verdict", ok: str = MATCH) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``col`` equals ``ok``, all other rows).

    Unlike ``==`` and ``!=`` on their own, a NULL lands in the second part."""
    good = F.coalesce(F.col(col) == ok, F.lit(False))
    return df.where(good), df.where(~good)


FINGERPRINT_SCHEMA = "database string, table_name string, n long, content_hash decimal(38,0), error string"


def fingerprints(spark: SparkSession, refs: Sequence[TableRef], schemas: dict | None = None,
                 columns: dict | None = None, frames: Sequence | None = None,
                 max_workers: int = 8) -> DataFrame:
    """Count and order-free content hash per table: (database, table_name, n,
    content_hash, error); NULLs and the error for a table that cannot be read.

    One job per table, submitted from a small driver pool (jobs share the
    cluster; planning runs in parallel; a table that fails at run time only
    nulls its own row).  Each job is a full distributed scan with map-side
    partial sums; the driver receives one row per table.  ``schemas`` pins
    the read schema (so a partitioned copy reads its partition columns with
    the source's types); ``columns`` pins the column order of the hash;
    ``frames`` passes tables already resolved."""
    columns, schemas = columns or {}, schemas or {}
    refs = list(refs)
    frames = list(frames) if frames is not None else [None] * len(refs)

    def one(item):
        ref, df = item
        key = (ref.database, ref.table)
        try:
            if df is None:
                df = read_table(spark, ref, schemas.get(key))
            if isinstance(df, Exception):
                raise df
            row = table_fingerprint(df, columns.get(key)).first()
            return (ref.database, ref.table, row["n"], row["content_hash"], None)
        except Exception as e:  # noqa: BLE001 - an unreadable table gets NULLs
            return (ref.database, ref.table, None, None, reason(e))

    with ThreadPoolExecutor(max_workers=max(1, min(max_workers, len(refs) or 1))) as pool:
        rows = list(pool.map(one, zip(refs, frames)))
    return records(spark, rows, FINGERPRINT_SCHEMA)


def verify_copies(spark: SparkSession, pairs: Sequence[tuple[TableRef, TableRef]],
                  content: bool = True, known_sources: dict | None = None, reasons: bool = False) -> DataFrame:
    """Row count and content of each copy against its source.

    Output: database, table_name, source_count, target_count, verdict, where
    verdict is ``match`` only when counts and content hashes are equal.
    ``content=False`` compares counts only (no column is read).
    ``known_sources`` maps (database, table) to the (rows, hash) observed
    while the copy was written (``copy_table``); those sources are not read
    again, so checking a copy reads only the copy.  ``reasons`` adds
    ``source_error`` and ``target_error``, why a side could not be read."""
    if not content:
        src = count_tables(spark, [s for s, _ in pairs], reasons=True)
        dst = count_tables(spark, [TableRef(s.database, s.table, d.provider, d.location,
                                            d.partition_columns, d.name, d.options) for s, d in pairs], reasons=True)
        out = verify_counts(src, dst)
        if reasons:
            for name, side in (("source_error", src), ("target_error", dst)):
                out = out.join(side.groupBy(*KEYS).agg(F.max("error").alias(name)), list(KEYS), "left")
        return out
    src_refs = [s for s, _ in pairs]
    src_frames = read_tables(spark, src_refs)
    schemas, columns = {}, {}
    for s, df in zip(src_refs, src_frames):
        if not isinstance(df, Exception):
            schemas[(s.database, s.table)] = df.schema
            columns[(s.database, s.table)] = df.schema.fieldNames()
    dst_refs = [TableRef(s.database, s.table, d.provider, d.location, d.partition_columns, d.name,
                         d.options) for s, d in pairs]
    known = known_sources or {}
    todo = [i for i, r in enumerate(src_refs) if (r.database, r.table) not in known]
    # Source and target jobs go through one pool, so both sides run together.
    rows = fingerprints(spark, [src_refs[i] for i in todo] + dst_refs, schemas, columns,
                        frames=[src_frames[i] for i in todo] + [None] * len(dst_refs)).collect()
    by_index = dict(zip(todo, rows[: len(todo)]))
    src_rows = [tuple(by_index[i]) if i in by_index else
                (r.database, r.table, *known[(r.database, r.table)], None) for i, r in enumerate(src_refs)]
    a = records(spark, src_rows, FINGERPRINT_SCHEMA)
    b = records(spark, rows[len(todo):], FINGERPRINT_SCHEMA)
    m = outer_match(a, b, KEYS, *[[F.col("n"), F.col("content_hash"), F.col("error")]] * 2)
    sc, tc = F.col("_l.n"), F.col("_r.n")
    v = count_verdict(F.col("_l"), F.col("_r"), sc, tc)
    v = F.when((v == MATCH) & ~F.col("_l.content_hash").eqNullSafe(F.col("_r.content_hash")),
               MISMATCH).otherwise(v)
    v = F.when((F.col("_l_n") > 1) | (F.col("_r_n") > 1), DUPLICATE).otherwise(v)
    why = [F.col("_l.error").alias("source_error"), F.col("_r.error").alias("target_error")] if reasons else []
    return m.select(*KEYS, sc.alias("source_count"), tc.alias("target_count"), v.alias("verdict"), *why)
