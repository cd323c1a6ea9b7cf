"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed rows.  A
batch states anew all rows of the documents that it touches: a document's
earlier contribution is subtracted and its new one (none for a delete) added,
so inserts, deletes and revised counts are one rule, and totals are never
recomputed from texts.

A state is a folder with three tables, one sub-folder per batch: ``deltas``
(signed rows per document), ``rollups`` (the same, summed per group) and
``commits``.  A batch writes its deltas, then its rollup from the written
deltas, then its commit row.  Readers see committed batches only: a batch that
broke off is written over when it is run again, and a committed one does
nothing.  ``compact`` sums a history of batches up in one.

Two batches at once that touch one document would both take its old count back.  So a
batch is written by one writer at a time: it first puts its name in ``writers``, then looks
who else stands there, and steps back (``Busy``, nothing written) if anyone does.  Of
two that write and then look, at least one sees the other.  A batch that broke off keeps its place until it
is run again, which completes it, or is let go by ``release``.

Per batch, one aggregation over the batch's rows and one join of the ledger with
the batch's doc_ids; groups are summed map-side first, so a source with a third
of all rows is one row per task.

Defined results: a null text has no tokens; null source or lang is a group of
its own; a null doc_id is one identity; rows that repeat a doc_id within a batch
are parts of one document and add up; a document both deleted and stated in a
batch is stated; an empty batch commits and changes nothing; groups whose
documents and tokens are all taken back drop out of the totals.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from contextlib import contextmanager
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, ship, whole_text, word_count

KEYS = ["doc_id", "source", "lang", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]
COMMIT = "batch string, replaces array<string>"
Counter = Callable[[Column], Column]


@lru_cache(8)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def bpe(spark: SparkSession, path: str, pattern: str) -> Counter:
    """A counter of byte-level BPE tokens; ``path`` names a vocabulary file of
    ranks (its size is that of the vocabulary: about 1 MB)."""
    ship(spark)
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        encode = _encoding(ranks.value, pattern).encode_ordinary
        return pa.array([len(encode(t)) for t in text.to_pylist()], pa.int64())

    return count


WORDS: Counter = word_count


def counted(docs: DataFrame, counters: dict[str, Counter]) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens): a row per document and version."""
    names = list(counters)
    wide = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       whole_text("text").alias("text"))
    wide = wide.select("doc_id", "source", "lang", *[counters[k](F.col("text")).alias(f"n{i}") for i, k in enumerate(names)])
    each = F.array(*[F.struct(F.lit(k).alias("tokenizer"), F.col(f"n{i}").cast("long").alias("tokens"))
                     for i, k in enumerate(names)])
    return wide.select("doc_id", "source", "lang", F.explode(each).alias("c")).select("doc_id", "source", "lang", "c.tokenizer", "c.tokens")


class Busy(RuntimeError):
    """Another batch is being written, or broke off and was not run again."""


class Rollup:
    """A state folder on shared storage."""

    def __init__(self, spark: SparkSession, path: str, doc_id: str = "long"):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = f"doc_id {doc_id}, source string, lang string, tokenizer string, docs long, tokens long"
        self._write_commit("begin", [], "ignore")

    def _write_commit(self, batch: str, replaces: list[str], mode: str = "overwrite") -> None:
        (self.spark.createDataFrame([(batch, replaces)], COMMIT).coalesce(1)
         .write.mode(mode).parquet(f"{self.path}/commits/{batch}"))

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def writers(self) -> list[str]:
        """Names of the batches being written, or broken off."""
        fs, at = self._path("writers")
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def release(self, batch: str) -> None:
        """Lets go of a batch that broke off and will not be run again."""
        fs, at = self._path("writers", self._named(batch))
        fs.delete(at, False)

    @staticmethod
    def _named(batch: str) -> str:
        if batch == "begin" or not re.fullmatch("[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"{batch!r} cannot name a batch: letters, digits, '-', '_' and '.', and not 'begin'")
        return batch

    @contextmanager
    def _alone(self, batch: str):
        """The only writer of the state, else ``Busy``.  An error inside leaves the batch its place."""
        fs, at = self._path("writers", batch)
        fs.mkdirs(at.getParent())
        mine = fs.createNewFile(at)                # False: this batch broke off before
        others = [w for w in self.writers() if w != batch]
        if others:
            if mine:
                fs.delete(at, False)
            raise Busy(f"{', '.join(others)} is being written or broke off: run it again, or release it")
        yield
        fs.delete(at, False)

    def _commits(self) -> dict[str, list[str]]:
        rows = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits/*").collect()      # one row per batch
        return {r["batch"]: r["replaces"] for r in rows if r["batch"] != "begin"}

    def committed(self) -> list[str]:
        """Names of the committed batches, compacted ones included."""
        return sorted(self._commits())

    def _read(self, name: str, schema: str) -> DataFrame:
        commits = self._commits()
        gone = {b for replaced in commits.values() for b in replaced}
        paths = [f"{self.path}/{name}/{b}" for b in sorted(commits) if b not in gone]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """What every document contributes now."""
        return (self._read("deltas", self.schema).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .where("docs <> 0 OR tokens <> 0"))

    def commit(self, batch: str, stated: DataFrame | None = None, deleted: DataFrame | None = None) -> bool:
        """Applies a batch once.  ``stated``: (doc_id, source, lang, tokenizer,
        tokens), the documents' new counts, replacing those of the same doc_id and
        tokenizer; ``deleted``: (doc_id), whose counts of every version go.
        Returns False if the batch was committed before; raises ``Busy`` if another is being written."""
        if self._named(batch) in self.committed():
            self.release(batch)                    # broke off between its commit row and its end
            return False
        with self._alone(batch):
            self._apply(batch, stated, deleted)
        return True

    def _apply(self, batch: str, stated: DataFrame | None, deleted: DataFrame | None) -> None:
        new, touched = [], []
        if stated is not None:
            stated = settled(stated.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens"))
            new.append(stated)
            touched.append(stated.select("doc_id", "tokenizer"))
        if deleted is not None:
            touched.append(deleted.select("doc_id", F.lit(None).cast("string").alias("tokenizer")))
        signed = list(new)
        if touched and self.committed():
            t = reduce(DataFrame.unionByName, touched).distinct().select(F.col("doc_id").alias("t_doc"), F.col("tokenizer").alias("t_tok"))
            now = self._read("deltas", self.schema)
            hit = F.col("doc_id").eqNullSafe(F.col("t_doc")) & (F.col("t_tok").isNull() | (F.col("t_tok") == F.col("tokenizer")))
            old = now.join(t, hit, "left_semi")
            signed.append(old.select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        rows = reduce(DataFrame.unionByName, signed) if signed else self.spark.createDataFrame([], self.schema)
        self._store(batch, rows, [])

    def compact(self, batch: str) -> bool:
        """Sums up all batches in one of name ``batch``, so that a long history costs
        one folder to read.  Its commit row names the batches it stands for: they are
        no longer read, and stay known, so a batch sent again still does nothing."""
        if self._named(batch) in self.committed():
            self.release(batch)
            return False
        with self._alone(batch):
            self._store(batch, self._read("deltas", self.schema), self.committed())
        return True

    def _store(self, batch: str, rows: DataFrame, replaces: list[str]) -> None:
        sums = [F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")]
        changed = "docs <> 0 OR tokens <> 0"
        at = f"{self.path}/deltas/{batch}"
        rows.groupBy(*KEYS).agg(*sums).where(changed).write.mode("overwrite").parquet(at)
        (self.spark.read.schema(self.schema).parquet(at).groupBy(*GROUP).agg(*sums).where(changed)
         .write.mode("overwrite").parquet(f"{self.path}/rollups/{batch}"))
        self._write_commit(batch, replaces)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens), from the rollups alone."""
        return (self._read("rollups", "source string, lang string, tokenizer string, docs long, tokens long")
                .groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .where("docs <> 0 OR tokens <> 0"))
