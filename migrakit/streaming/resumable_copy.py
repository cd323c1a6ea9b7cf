"""K1/K3 as a restartable stream.

A batch copy of a very large table that dies near the end starts over.  As a
Structured Streaming query with ``trigger(availableNow=True)`` the same copy
runs in micro-batches of a bounded number of source files; the checkpoint
(offsets) and the file sink's commit log (``_spark_metadata``) make each batch
exactly-once, so a rerun after a driver or executor loss continues where it
stopped, and a later rerun copies only files that arrived since.  Readers of
the target see only committed batches.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import SparkSession

from ..session import work_dir
from ..sources.tables import TableRef, fingerprint_exprs, partition_columns, read_table


def copy_resumable(spark: SparkSession, src: TableRef, ext_loc: str, checkpoint: str | None = None,
                   to_format: str = "parquet", max_files_per_trigger: int = 1000) -> dict:
    """Copy the files of ``src`` to ``ext_loc`` as an available-now stream.

    A micro-batch takes ``max_files_per_trigger`` files, so a restart repeats at
    most that many.  Files are taken however old they are.

    ``checkpoint`` must be in shared storage and stay with the target (a new
    one means a new copy); by default it is a folder under the session's
    shared root.  Each micro-batch writes narrow (no shuffle): right for
    keeping a source's layout; a copy into a new partition layout is better
    done by the batch ``copy_table``, whose rebalance AQE can split.  What is
    written is fingerprinted in the write, batch by batch, so the check of a
    copy made in one run reads only the copy.  Returns (database, table_name,
    ext_loc, checkpoint, batches, rows, source_rows, source_hash) for the run; ``rows`` is NULL where
    a stalled driver missed the progress of a batch between others."""
    if not src.location:
        raise ValueError("a resumable copy reads files: the source needs a location")
    schema = read_table(spark, src).schema  # a file stream needs its schema up front
    reader = spark.readStream.format(src.provider or "parquet").schema(schema)
    reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger)).option("maxFileAge", "36500d")
    for k, v in src.options:
        reader = reader.option(k, v)
    location = src.location.rstrip("/")
    if _is_file(spark, location):
        # A file stream watches a folder; a single-file table is read as a
        # glob that matches exactly its own name inside its folder.
        parent, name = location.rsplit("/", 1)
        location = f"{parent}/{{{name}}}"
    stream = reader.load(location)
    try:
        stream = stream.observe("copied", *fingerprint_exprs(schema))
    except Exception:  # noqa: BLE001 - types that cannot be hashed: the copy goes on without
        pass
    parts = partition_columns(spark, src)
    ckpt = checkpoint or work_dir(spark, "checkpoints", src.database, src.table)
    writer = (stream.writeStream.format(to_format).option("checkpointLocation", ckpt)
              .trigger(availableNow=True).queryName(f"copy_{src.database}_{src.table}"))
    if parts:
        writer = writer.partitionBy(*parts)
    query = writer.start(ext_loc)
    # A query remembers only its latest progress entries (100 by default), so
    # they are gathered while it runs; no query commits 100 batches in half a second.
    seen: dict[int, tuple] = {}
    ended = False
    while not ended:
        ended = query.awaitTermination(0.5)
        for p in query.recentProgress:
            seen[p["batchId"]] = (p["numInputRows"], p["observedMetrics"].get("copied"))
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    batches = max(seen) - min(seen) + 1 if seen else 0
    return {"database": src.database, "table_name": src.table, "ext_loc": ext_loc,
            "checkpoint": ckpt, "batches": batches,
            "rows": sum(n for n, _ in seen.values()) if len(seen) == batches else None, **_fingerprint(seen)}


def _fingerprint(seen: dict[int, tuple]) -> dict:
    """Rows and content hash of everything the checkpoint has copied, summed over
    its batches; NULL for a run that resumed one (earlier batches were observed
    by another run)."""
    parts = [m for _, m in seen.values()]
    if sorted(seen) != list(range(len(seen))) or any(m is None for m in parts):
        return {"source_rows": None, "source_hash": None}
    hashes = [m["content_hash"] for m in parts if m["content_hash"] is not None]
    return {"source_rows": sum(m["n"] for m in parts), "source_hash": sum(hashes, Decimal(0)) if hashes else None}


def _is_file(spark: SparkSession, location: str) -> bool:
    """Whether ``location`` is a single file (Hadoop file system check)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(location)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(path) and fs.getFileStatus(path).isFile()
