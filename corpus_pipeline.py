"""The training-data pipeline: language ID, SimHash near-dedup, benchmark
decontamination, mixing to target weights, sharding.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), and its
result is written as Parquet and read again as the next one's ``docs``.  All
but the last return the columns of ``documents``; the last adds ``shard`` and
``slot``, which take the place of columns of those names (in any letter case).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from migrakit.llm import decontaminate, langid, mixing, sharding, simhash
from migrakit.llm.common import written


#: A text of this many letters or more must reach this cosine with its best language.  Unrelated texts differ from 0 by
#: 1 / 32 on average (1,024 dimensions): 0.125 is four times that; a text of few letters proves nothing.
MIN_LETTERS, MIN_COSINE = 100, 0.125


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents to which a language is given: those with a letter, unless they
    are long and like none of the languages (encoded data, a script nobody
    labelled).  Learns from the labelled ones; where nothing is labelled, letters
    alone decide."""
    model = langid.learn(docs.select("text", "lang"))
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    guess = "_".join(["lang_id", *docs.columns])            # clashes with no column
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    foreign = (F.col(f"`{guess}`.score") < MIN_COSINE) & (letters >= MIN_LETTERS)
    return langid.identify(docs, model, guess).where((F.col(f"`{guess}`.lang") != langid.UNKNOWN) & ~foreign).drop(guess)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the smallest doc_id."""
    return simhash.dedup(docs, shingle=3, distance=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.without_documents(docs, items, n=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time a document is taken, in training order."""
    return mixing.training_order(mixing.mix(docs))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of near-equal bytes in the order of the rows in
    their files, which the mix has sorted by training position: by the number in a
    part file's name (as a number), its path, and the row's place in it.  A frame
    that does not come straight from files has no such order and is ordered by
    digest."""
    name = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1)
    order = [F.when(name != "", name.cast("long")), F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        docs.select(*order)
    except AnalysisException:
        order = None
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return sharding.shard(docs, shards=8, order=order, keep=keep).select("row.*", "shard", "slot")


STAGES = [("language_id", language_id), ("simhash_dedup", near_dedup), ("decontaminate", decontamination),
          ("mix_sources", mix), ("shard", shards)]

#: Learned languages and components of near duplicates have no SQL statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
