"""The record of copies: one small JSON file per step, written when the step is
done and never changed, so a driver that is lost takes no outcome with it.

A target's record lies beside it (``_copy_journal/<name>``); ``read_journal`` reads
the records of many targets as one table.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession

JOURNAL_SCHEMA = ("at long, step string, run string, database string, table_name string, curr_loc string, ext_loc string, "
                  "format string, rows long, hash string, files long, bytes long, error string")


def file_system(spark: SparkSession, location: str):
    """(file system, path) of a location."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def beside(location: str, prefix: str, suffix: str = "") -> str:
    """A hidden sibling of a target."""
    parent, _, name = location.rstrip("/").rpartition("/")
    return f"{parent}/{prefix}{name}{suffix}"


def journal_dir(location: str) -> str:
    return beside(location, "_copy_journal/")


class Journal:
    """The record of the copies to one target."""

    def __init__(self, spark: SparkSession, location: str, **fixed):
        self.spark, self.location, self.fixed = spark, location, {**fixed, "run": uuid.uuid4().hex[:12]}

    def write(self, step: str, **values) -> None:
        row = {**self.fixed, "at": time.time_ns(), "step": step, **values}
        fs, path = file_system(self.spark, f"{journal_dir(self.location)}/{row['at']}-{self.fixed['run']}.json")
        out = fs.create(path, False)
        out.write(json.dumps(row).encode())
        out.close()

    def published(self) -> dict | None:
        """The last copy that reached the target, as its record tells."""
        fs, path = file_system(self.spark, journal_dir(self.location))
        if not fs.exists(path):
            return None
        last = (read_journal(self.spark, [self.location]).where("step IN ('published', 'verified')")
                .orderBy("at", ascending=False).limit(1).collect())
        return last[0].asDict() if last else None


def read_journal(spark: SparkSession, locations: Iterable[str]) -> DataFrame:
    """Every step recorded for some targets, one row each (``at`` in nanoseconds)."""
    found = [d for d in map(journal_dir, locations) if file_system(spark, d)[0].exists(file_system(spark, d)[1])]
    if not found:
        return spark.createDataFrame([], JOURNAL_SCHEMA)
    return spark.read.schema(JOURNAL_SCHEMA).json(found)
