"""The registered queries: each operator over its whole table with production
parameters, and its DuckDB statement where SQL can say the same.

``queries()`` maps a name to a function of (spark, sf_dir); ``oracle_sql()``
maps it to the statement.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from . import (decontaminate, exact_dedup, hard_negatives, langid, line_dedup, lm_score, mixing, pii, prefix_trie, sharding, simhash,
               substring_dedup, token_counts)
from .common import settled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def queries() -> dict[str, Query]:
    import corpus_pipeline
    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline
    return dict(ORACLE) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


# --- 1: mixing sources to target weights ---------------------------------

OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, CAST(source_size AS DOUBLE) * 3.0::DOUBLE AS cap,
         (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(CAST(source_size AS DOUBLE) * 3.0::DOUBLE) OVER before, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level,
         row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) * 3.0::DOUBLE / weight, source NULLS LAST) AS place
  FROM s
  WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) * 3.0::DOUBLE / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE * (2.0::DOUBLE - weight))) AS d,
         least(cap, coalesce(min_by(level, place) FILTER (WHERE cap > level * weight) OVER () * weight, cap)) AS target
  FROM l),
p AS (
  SELECT doc_id, h, size, source_size, target, 1.0::DOUBLE + d AS r0, ((1.0::DOUBLE - d) - (1.0::DOUBLE + d)) AS a,
         (1.0::DOUBLE + d + (1.0::DOUBLE - d)) / 2.0::DOUBLE AS whole,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (
  SELECT *, (start + size / 2.0::DOUBLE) AS m0,
         CAST(start + size / 2.0::DOUBLE < target AS BIGINT)
         + CAST(source_size + start + size / 2.0::DOUBLE < target AS BIGINT)
         + CAST(2 * source_size + start + size / 2.0::DOUBLE < target AS BIGINT) AS copies,
         CASE WHEN target > 0 THEN m0 / target * whole END AS q
  FROM p)
SELECT doc_id, size, source_size, target, copies * size AS taken, CAST(copies AS INTEGER) AS copies,
       CASE WHEN copies > 0 THEN round(q * 2.0::DOUBLE / (r0 + sqrt(greatest(0.0::DOUBLE, r0 * r0 + a * 2.0::DOUBLE * q))), 6)
       END AS first_position
FROM m
"""


@query("op1_mix_sources", OP1_SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                    F.col("copies").cast("int").alias("copies"),
                    F.round(F.get(F.col("positions"), F.lit(0)), 6).alias("first_position"))


# --- 5: line dedup ---------------------------------------------------------

OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (
  SELECT key, min(doc_id) AS keep FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (
  SELECT k.doc_id, pos, line, m.key IS NOT NULL AND k.doc_id <> m.keep AS lost FROM k LEFT JOIN m ON k.key = m.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


@query("op5_line_dedup", OP5_SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


# --- 7: benchmark decontamination -------------------------------------------

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, w[i : i + least(len(w), 10) - 1] AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (
  SELECT doc_id, n, i, w[i : i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.i, p.n, v.item FROM p JOIN v ON p.n = v.n AND p.win = v.win),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""


@query("op7_decontaminate", OP7_SQL)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return c.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


# --- 8: sharding --------------------------------------------------------------

OP8_SQL = """
WITH t AS (   -- table of CRC-32 (reversed polynomial EDB88320)
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
h AS (SELECT doc_id, md5(coalesce(text, '')) AS digest, hex(encode(coalesce(text, ''))) AS hx FROM documents),
b AS (
  SELECT doc_id, digest, CAST(length(hx) // 2 + 1 AS BIGINT) AS size,
         list_transform(range(0, CAST(length(hx) AS BIGINT), 2), lambda i: CAST(concat('0x', substr(hx, i + 1, 2)) AS BIGINT)) AS bytes
  FROM h),
d AS (
  SELECT doc_id, digest, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
         lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
p AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY digest, doc_id) - size AS DOUBLE) AS before, CAST(sum(size) OVER () AS DOUBLE) AS total
  FROM d),
k AS (
  SELECT *, least(floor((before + size / 2.0::DOUBLE) * 8.0::DOUBLE / total), 7) AS cut,
         CAST(sum(size) OVER (PARTITION BY digest) AS DOUBLE) AS grp, min(before) OVER (PARTITION BY digest) AS beg FROM p),
s AS (   -- a group of equal texts of at most a hundredth of a shard is not cut
  SELECT *, CAST(CASE WHEN grp * 8.0::DOUBLE <= total * 0.01::DOUBLE
                      THEN least(floor((beg + grp / 2.0::DOUBLE) * 8.0::DOUBLE / total), 7) ELSE cut END AS INTEGER) AS shard FROM k)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY digest, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""


@query("op8_shard_bytes", OP8_SQL)
def op8_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard(table(spark, sf_dir, "documents"), shards=8, keep=["doc_id"])
    return s.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


# --- 9: SimHash near-dedup (components: no statement) ------------------------

@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3, keep=["doc_id"])
    return d.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- 3: exact dedup ----------------------------------------------------------

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""


@query("op3_exact_dedup", OP3_SQL)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return d.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


# --- 4: language ID (a learned model: no statement) ---------------------------

@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"))
    model = langid.learn(docs.where(~out))
    return (langid.identify(docs.select("doc_id", "text"), model)
            .select("doc_id", out.alias("held_out"), F.col("lang_id.lang").alias("lang_pred"), F.col("lang_id.score").alias("score")))


# --- 2: language-model scoring (a learned model: no statement) ---------------

@query("op2_ctw_score")
def op2_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    s = lm_score.score(docs, held, depth=5, least=1)
    return s.select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                    (-F.col("score") * 3.321928094887362 / F.col("n_bytes")).alias("bits_per_byte"))


# --- 6: token counts (a real tokenizer: no statement) ------------------------

#: Vocabulary of the BPE version and its pre-tokenisation pattern: parameters.
TOKENIZER = "byte_bpe_50k"


@query("op6_token_rollup")
def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load of all documents, a batch that takes back every copy of an earlier
    text, a batch that counts shouted texts anew in lower case, and the load once
    more (already committed: no effect)."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    versions = {"words-1": token_counts.WORDS,
                f"{TOKENIZER}-1": token_counts.bpe(spark, public_tokenizers.path(f"{TOKENIZER}.tiktoken"), public_tokenizers.PATTERN)}
    state = token_counts.Rollup(spark, work_dir(spark, "llm", "token-rollup"))
    state.commit("load", stated=token_counts.counted(docs, versions))
    h = F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    texts = docs.select("doc_id", h.alias("h"))
    first = settled(texts.groupBy("h").agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    copies = settled(texts.join(first, "h").where(F.col("doc_id") != F.col("keep")).select("doc_id"))
    state.commit("retract-copies", deleted=copies)
    loud = docs.where((F.upper("text") == F.col("text")) & (F.lower("text") != F.col("text")))
    loud = loud.join(copies, "doc_id", "left_anti").withColumn("text", F.lower("text"))
    state.commit("revise", stated=token_counts.counted(loud, versions))
    state.commit("load", stated=token_counts.counted(docs, versions))
    return state.totals()


# --- 10: PII pseudonyms --------------------------------------------------------

@query("op10_pseudonymise")
def op10_pseudonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pii.pseudonymise(table(spark, sf_dir, "documents"), key="op10", keep=["doc_id"])
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).alias(f"n_{k}")
    return p.select("row.doc_id", "text", F.size("kinds").alias("n_values"),
                    *[count(k) for k in ("email", "card", "phone", "ip", "iban", "ssn", "date")])


# --- 11: hard-negative mining -----------------------------------------------

OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256.0::DOUBLE * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.u, a.vec_id AS anchor_id, b.vec_id AS id, b.label = a.label AS same,
         CASE WHEN len(a.e) = 0 THEN 0 ELSE CAST(list_dot_product(a.e, b.e) AS BIGINT) END AS score
  FROM v a JOIN v b ON a.u <> b.u AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT u, anchor_id, id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY u ORDER BY score DESC, id) AS place
  FROM s WHERE same QUALIFY place <= 5),
n AS (
  SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.u, place ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.u = p.u AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
  QUALIFY rank <= 10)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n
"""


@query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vec.select("vec_id", moved.alias("label"), hard_negatives.quantised(F.col("embedding"), 256).alias("vector"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, window=(30, 90))


# --- 12: conversation prefix trie ---------------------------------------------

OP12_SQL = """
WITH t AS (   -- table of CRC-32 (reversed polynomial EDB88320)
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, count(*) AS n, hex(encode(CAST(c AS VARCHAR))) AS hx FROM o GROUP BY c),
h AS (
  SELECT c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, CAST(length(hx) AS BIGINT), 2),
         lambda i: CAST(concat('0x', substr(hx, i + 1, 2)) AS BIGINT))),
         lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) % 6 AS h FROM l, t),
m AS (SELECT h.c, h.h, h.c - h.c % 100 AS base, least(h.h, coalesce(b.n, 0)) AS m FROM h LEFT JOIN l b ON b.c = h.c - h.c % 100),
r AS (
  SELECT m.c, pos - h + m AS pos, k, length(text) AS chars FROM m JOIN o ON o.c = m.c WHERE pos >= h
  UNION ALL SELECT m.c, pos, k, length(text) FROM m JOIN o ON o.c = m.base WHERE pos < m),
s AS (SELECT m.c, coalesce(list(k ORDER BY pos) FILTER (WHERE k IS NOT NULL), []) AS seq FROM m LEFT JOIN r ON r.c = m.c GROUP BY m.c),
p AS (SELECT c, len(seq) AS n, seq[1:d] AS path, d FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM s)),
g AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, path[1:d - 1] AS above,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM p GROUP BY path, d),
n AS (
  SELECT g.*, up.conv_id AS parent_conv_id, coalesce((g.n_convs - 1) * r.chars, 0) AS saving,
         (SELECT count(*) FROM g x WHERE x.d = g.d + 1 AND x.above = g.path) AS n_children
  FROM g LEFT JOIN g up ON g.d > 0 AND up.d = g.d - 1 AND up.path = g.above LEFT JOIN r ON r.c = g.conv_id AND r.pos = g.d - 1),
u AS (   -- every node under each of its ancestors, itself included
  SELECT path[1:i] AS top, i, n_children = 0 AS leaf, saving FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM n)),
v AS (SELECT top, i, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saving) AS saved FROM u GROUP BY top, i)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(ends) AS ends_sha256
FROM n JOIN v ON v.i = n.d AND v.top = n.path
"""


@query("op12_prefix_trie", OP12_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prefix_trie.turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(own, family=100, heads=6))


# --- 13: substring dedup -----------------------------------------------------------

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (
  SELECT u, i, md5(array_to_string(w[i : i + 34], ' ')) AS h
  FROM (SELECT u, w, unnest(range(1, CAST(len(w) AS BIGINT) - 33)) AS i FROM d WHERE len(w) >= 35)),
a AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT u, j FROM (SELECT u, unnest(range(i, i + 35)) AS j FROM p JOIN a ON p.h = a.h)),
k AS (
  SELECT x.u, string_agg(x.word, ' ' ORDER BY x.j) FILTER (WHERE c.j IS NULL) AS kept, count(c.j) AS gone
  FROM (SELECT u, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d) x LEFT JOIN c ON c.u = x.u AND c.j = x.j GROUP BY x.u)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.u = d.u
"""


@query("op13_substring_dedup", OP13_SQL)
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"], digest=True, window=35)
    return d.select("row.doc_id", "n_words", "n_removed", "kept_sha256")
