"""Benchmark decontamination: word windows of test items found in documents.

The items' windows of ``n`` words (an item of fewer words is one window) form
a hash set that is broadcast; every window of every document is hashed and
looked up, and a hit is verified on the words themselves.  All of it is one
narrow stage over the documents; only hits are shuffled.

The set is broadcast in blocks of at most ``block`` windows, each over all
documents, so what an executor holds is bounded however large the benchmark is
(usually there is one block).  A window that a third of all documents hold
meets no shuffle; hits are then grouped by document.

Defined results: a null text has no words, and an item without words has no
windows; documents with equal (doc_id, text) share their result, so repeated
rows are each reported; an empty table of either side gives no hits; equal
items are each counted; other columns of the caller are kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parallel import let
from .common import fold_ascii, outside, packed_columns, row_key, settled, whole_text

#: Digits, letters of ASCII and everything beyond it: before or after A-Z are
#: lower-cased, the words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.  A positive class of
#: few ranges is matched about 2.5 times faster than the negated one.
BENCH_WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
BENCH_GAP = r"[^0-9A-Za-z\x80-\x{10FFFF}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(fold_ascii(text), F.lit(BENCH_WORD), F.lit(0))


def item_windows(items: DataFrame, n: int = 10) -> DataFrame:
    """Distinct windows: (h, len, window, items), items being the item_ids as
    strings."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                     F.explode(F.array(_words(whole_text("text")))).alias("words"))
    w = w.where(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(n)))
    w = w.select("item", "len", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("at"))
    return (w.select("item", "len", F.slice("words", F.col("at"), F.col("len")).alias("window"))
            .groupBy("len", "window").agg(F.collect_set("item").alias("items"))
            .select(F.xxhash64("window").alias("h"), "len", "window", "items"))


def _hits(texts: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(rk, pos, len, items) of every window that occurs."""
    found = []
    for n in lengths:
        at = texts.where(F.size("words") >= n).select(
            "rk", "words", F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("pos"))
        here = F.slice("words", F.col("pos") + 1, F.lit(n))
        at = at.withColumn("h", F.xxhash64(here))
        # The words are compared on hits only: a bare equality would become part of the join key.
        same = here.between(F.col("window"), F.col("window"))
        found.append(at.join(F.broadcast(windows.where(F.col("len") == n)), "h").where(same)
                     .select("rk", "pos", "len", "items"))
    return reduce(DataFrame.unionByName, found)


def hits(docs: DataFrame, items: DataFrame, n: int = 10, block: int = 200_000) -> DataFrame:
    """(rk, spans, n_hit, items) of every document with a hit: disjoint word
    spans (begin, end), the number of words inside, the item_ids as strings."""
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rk"),
                        F.explode(F.array(_words(whole_text("text")))).alias("words"))
    windows = item_windows(items, n)
    sizes = {r["len"]: r["count"] for r in windows.groupBy("len").count().collect()}     # n rows at most
    schema = "rk binary, pos int, len int, items array<string>"
    blocks = -(-sum(sizes.values()) // block)
    parts = [_hits(texts, windows.where(F.pmod("h", F.lit(blocks)) == b) if blocks > 1 else windows, sorted(sizes))
             for b in range(blocks)]
    found = reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    grouped = found.groupBy("rk").agg(
        F.sort_array(F.collect_set(F.struct("pos", (F.col("pos") + F.col("len")).alias("end")))).alias("at"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # Disjoint spans: runs of consecutive covered words, in time linear in the words that windows cover.
    cover = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda s: F.sequence(s["pos"], s["end"] - 1)))))

    def runs(c: Column) -> Column:
        begins = F.filter(c, lambda x, i: F.coalesce(F.get(c, i - 1) < x - 1, F.lit(True)))
        ends = F.filter(c, lambda x, i: F.coalesce(F.get(c, i + 1) > x + 1, F.lit(True)))
        return F.zip_with(begins, ends, lambda x, y: F.struct(x.alias("begin"), (y + 1).alias("end")))

    spans = let(cover, runs)
    # Checkpointed: the join with the documents is between two plain shuffles,
    # so many equal rows of one document are split by AQE.
    return settled(grouped.select("rk", spans.alias("spans"), "items")
                   .withColumn("n_hit", F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["begin"])))


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, block: int = 200_000,
                  keep: list[str] | None = None) -> DataFrame:
    """(row, n_words, n_hit, items, spans, contaminated) of every document; ``row``
    holds the columns ``keep`` (default all)."""
    base = docs.select(packed_columns(docs, keep), row_key(F.col("doc_id"), F.col("text")).alias("rk"),
                       F.regexp_count(whole_text("text"), F.lit(BENCH_WORD)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    found = hits(docs, items, n, block)
    return (base.join(found, "rk", "left")
            .select("row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.sort_array(F.coalesce("items", none)).alias("items"), "spans")
            .withColumn("contaminated", F.col("n_hit") > 0))


def without_documents(docs: DataFrame, items: DataFrame, n: int = 10, max_hit: int = 0) -> DataFrame:
    """The documents of at most ``max_hit`` hit words."""
    return contamination(docs, items, n).where(F.col("n_hit") <= max_hit).select("row.*")


def without_spans(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Every document, its text without the hit words (and the gap after each);
    texts without a hit are unchanged."""
    c = contamination(docs, items, n)
    # Pieces: one leading gap (maybe empty), then every word with the gap that follows it.
    lead = F.regexp_extract(F.col("row.text"), f"^({BENCH_GAP})", 1)
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(f"{BENCH_WORD}(?:{BENCH_GAP})?"), F.lit(0))
    text = F.when(F.col("n_hit") == 0, F.col("row.text")).otherwise(
        F.concat(lead, F.array_join(outside(pieces, F.col("spans")), "")))
    return c.select(F.col("row").withField("text", text).alias("row")).select("row.*")
