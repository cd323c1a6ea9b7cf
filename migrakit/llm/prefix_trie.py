"""The trie of conversation prefixes, by the Euler-tour technique.

Every distinct sequence of first d turns is a node, the textless root
included.  Turns become (position, digest of role and text); a prefix is named
by its length and the exclusive-or of 128 hashed bits of (position, digest),
which adds up over blocks of turns, so no conversation has to be in one task.

Nodes are numbered by (smallest member, depth).  Every node has an enter and an
exit arc; an arc's successor is the next arc of a depth-first walk, children in
the order of their numbers.  The tour is list-ranked in two steps:

1. arcs of ``BLOCK`` neighbouring nodes are walked together in one task, which
   contracts the tour to the chains that enter and leave a block;
2. pointer jumping on what is left, about log2 of the number of chains rounds.

Prefix sums of leaves and savings at arc positions then give every subtree's
totals as a difference between its exit and its enter arc.  SHA-256 of a node's
ends is fed with sorted pieces of ids, one task per node, in bounded memory (the
digest is sequential by definition; the pieces are built in parallel).

Children of one node are chained in groups of 4,096 numbers per level, so a node
with many children is not in one task either.

Defined results: rows without a conv_id take no part; null role or text is empty;
turns with equal numbers are ordered by the SHA-256 of role and text, equal rows
are separate turns; an empty table has no root and gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import settled, ship, whole_text, written

#: Nodes whose arcs are walked together; width of a group of siblings, a block of turns, a block of arcs, a piece of ids.
BLOCK = GROUP = 4096

_L, _I = LongType(), IntegerType()
_AT = StructType([StructField("part", _I), StructField("at", _L)])
_CHAINED = StructType([StructField("arc", _L), StructField("head", _L), StructField("offset", _L), StructField("next", _L),
                       StructField("steps", _L)])


# --- dense numbers ----------------------------------------------------------

def _counted(batches):
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()),
                                          pa.array(range(at, at + b.num_rows), pa.int64())], names=[*b.schema.names, "part", "at"])
        at += b.num_rows


def numbered(df: DataFrame, keys: list[str], name: str, number: str) -> DataFrame:
    """``df`` with the place of every row in the order of ``keys`` (nulls first),
    from 0: one range sort, written, and one offset per partition."""
    keyed = df.withColumn("_tie", F.monotonically_increasing_id())                  # splits equal rows
    rows = keyed.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    rows = written(rows.mapInArrow(_counted, StructType([*rows.schema.fields, *_AT.fields])), name)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)       # one row per partition
    offsets = (rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
               .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0")))
    return rows.join(F.broadcast(offsets), "part").withColumn(number, F.col("at") + F.col("n0")).drop("part", "at", "n0")


# --- conversations ------------------------------------------------------------

def turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, key, chars): every turn with its place in its conversation."""
    role, text = whole_text("role"), whole_text("text")
    key = F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)
    base = (conversations.where(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), key.alias("key"),
                    F.char_length(text).cast("long").alias("chars")))
    rows = numbered(base, ["conv", "turn", "key"], "trie-order", "r").drop("turn")
    first = settled(rows.groupBy("conv").agg(F.min("r").alias("first")))
    rows = rows.join(first, "conv").select("conv", (F.col("r") - F.col("first")).alias("pos"), "key", "chars")
    return written(rows, "trie-turns")


def with_shared_heads(own: DataFrame, family: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rebuilds every conversation c as the first h turns of conversation c - c %
    family, then its own turns after its first h; h = crc32(c) % heads.  Returns
    (turns, conversations with their number of turns)."""
    conv = F.col("conv")
    h = (F.crc32(conv.cast("string").cast("binary")) % heads).cast("long")
    lengths = settled(own.groupBy("conv").agg(F.count(F.lit(1)).alias("n")))
    base = lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    members = (lengths.select("conv", "n", h.alias("h"), (conv - conv % family).alias("base")).join(base, "base", "left")
               .withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0)))))
    members = settled(members.select("conv", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))
    tails = (own.join(members.select("conv", "h", "m"), "conv").where("pos >= h")
             .select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "key", "chars"))
    begin = own.where(F.col("pos") < heads).select(F.col("conv").alias("base"), "pos", "key", "chars")
    shared = members.where("m > 0").select("conv", "base", "m").join(begin, "base").where("pos < m")
    return tails.unionByName(shared.select("conv", "pos", "key", "chars")), members.select("conv", "n")


# --- nodes ----------------------------------------------------------------------

def _prefixes(rows: DataFrame) -> DataFrame:
    """Adds depth, the name (f1, f2) of the prefix that ends with a turn, and that
    of the prefix before it."""
    x = [F.xxhash64(F.lit(i), F.col("pos"), F.col("key")) for i in (1, 2)]
    rows = rows.select("conv", "pos", "chars", x[0].alias("x1"), x[1].alias("x2"), F.floor(F.col("pos") / GROUP).alias("block"))
    inside = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("f1", F.bit_xor("x1").over(inside)).withColumn("f2", F.bit_xor("x2").over(inside))
    rows = written(rows, "trie-prefixes")
    # Only conversations longer than a block carry something from block to block.
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    long = rows.where("block > 0").select("conv").distinct()
    carry = (rows.join(long, "conv", "left_semi").groupBy("conv", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
             .select("conv", "block", F.bit_xor("b1").over(before).alias("c1"), F.bit_xor("b2").over(before).alias("c2"))
             .where("c1 is not null"))
    rows = rows.join(settled(carry), ["conv", "block"], "left")
    f = [F.col(f"f{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("long"))) for i in (1, 2)]
    return rows.select("conv", (F.col("pos") + 1).alias("depth"), "chars", f[0].alias("f1"), f[1].alias("f2"),
                       f[0].bitwiseXOR(F.col("x1")).alias("p1"), f[1].bitwiseXOR(F.col("x2")).alias("p2"))


def _nodes(prefixes: DataFrame, members: DataFrame) -> DataFrame:
    """(node, conv_id, depth, f1, f2, p1, p2, n_convs, saving); node 0 is the root."""
    zero = F.lit(0).cast("long")
    nodes = (prefixes.groupBy("depth", "f1", "f2")
             .agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
                  F.max("p1").alias("p1"), F.max("p2").alias("p2")))
    root = (members.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
            .select(zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), "conv_id", "n_convs", zero.alias("chars"),
                    zero.alias("p1"), zero.alias("p2")))
    nodes = nodes.unionByName(root).withColumn("saving", (F.col("n_convs") - 1) * F.col("chars")).drop("chars")
    return numbered(nodes, ["conv_id", "depth"], "trie-nodes", "node")


# --- the tour ---------------------------------------------------------------------

def _siblings(children: DataFrame, n: int) -> DataFrame:
    """(a, b): b is the next sibling of a.  Groups of GROUP numbers per level: the
    last child of a group is chained to the first of the next one a level up."""
    level, pairs = children.select("parent", F.col("node").alias("a"), F.col("node").alias("b"), F.col("node").alias("g")), None
    while True:
        level = level.withColumn("up", F.floor(F.col("g") / GROUP))
        order = Window.partitionBy("parent", "up").orderBy("g")
        here = (level.select(F.col("b").alias("a"), F.lead("a").over(order).alias("b")).where("b is not null"))
        pairs = here if pairs is None else pairs.unionByName(here)
        if n <= GROUP:
            return pairs
        level = level.groupBy("parent", "up").agg(F.min("a").alias("a"), F.max("b").alias("b")).withColumnRenamed("up", "g")
        n = -(-n // GROUP)


def _walk(t: pa.Table) -> pa.Table:
    """The chains of one block: where every arc lies on its chain, and where a
    chain leads to (on the head's row)."""
    arcs, nexts = t.column("arc").to_numpy(), t.column("next").to_numpy()
    after = dict(zip(arcs.tolist(), nexts.tolist()))
    inner = set(nexts.tolist())
    out = []
    for head in arcs.tolist():
        if head in inner:
            continue
        arc, i, first = head, 0, len(out)
        while arc in after:
            out.append([arc, head, i, None, None])
            arc, i = after[arc], i + 1
        out[first][3:] = [arc, i]
    return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], names=_CHAINED.names)


def list_rank(tour: DataFrame) -> DataFrame:
    """(arc, position) of a list given as (arc, next), with next -1 at its end."""
    chains = written(tour.groupBy(F.floor(F.col("arc") / (2 * BLOCK)).alias("block")).applyInArrow(_walk, _CHAINED), "trie-chains")
    heads = chains.where("next is not null").select(F.col("arc").alias("head"), "next", "steps")
    # Pointer jumping: next and steps double their reach every round; every head is pointed at by one other at most.
    todo = settled(heads)
    done = None
    while True:
        ended = todo.where("next = -1")
        other = todo.select(F.col("head").alias("next"), F.col("next").alias("next2"), F.col("steps").alias("steps2"))
        if done is not None:
            other = other.unionByName(done.select(F.col("head").alias("next"), F.col("next").alias("next2"), F.col("steps").alias("steps2")))
        done = ended if done is None else settled(done.unionByName(ended))
        going = todo.where("next <> -1")
        todo = settled(going.join(other, "next").select("head", F.col("next2").alias("next"), (F.col("steps") + F.col("steps2")).alias("steps")))
        if todo.isEmpty():
            break
    left = done.select("head", F.col("steps").alias("to_end"))
    total = tour.agg(F.count(F.lit(1)).alias("total"))
    return (chains.select("arc", "head", "offset").join(left, "head").join(F.broadcast(total))
            .select("arc", (F.col("total") - F.col("to_end") + F.col("offset")).alias("position")))


def _subtrees(tour: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens): prefix sums at arc positions, exit minus
    enter.  ``weights``: (arc, leaf, saving) of the enter arcs."""
    zero = F.lit(0).cast("long")
    arcs = (list_rank(tour).join(weights, "arc", "left")
            .select("arc", "position", F.coalesce("leaf", zero).alias("leaf"), F.coalesce("saving", zero).alias("saving"),
                    F.floor(F.col("position") / GROUP).alias("block")))
    arcs = written(arcs, "trie-arcs")
    blocks = arcs.groupBy("block").agg(F.sum("leaf").alias("bl"), F.sum("saving").alias("bs"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)      # one row per 4,096 arcs
    blocks = settled(blocks.select("block", F.coalesce(F.sum("bl").over(earlier), zero).alias("bl"),
                                   F.coalesce(F.sum("bs").over(earlier), zero).alias("bs")))
    inside = Window.partitionBy("block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    sums = (arcs.withColumn("l", F.sum("leaf").over(inside)).withColumn("s", F.sum("saving").over(inside)).join(blocks, "block")
            .select(F.floor(F.col("arc") / 2).alias("node"), (F.col("arc") % 2 == 1).alias("out"), (F.col("l") + F.col("bl")).alias("l"),
                    (F.col("s") + F.col("bs")).alias("s"), "leaf", "saving"))
    diff = lambda at, own: F.sum(F.when(F.col("out"), F.col(at)).otherwise(F.col(own) - F.col(at)))
    return sums.groupBy("node").agg(diff("l", "leaf").alias("n_leaves"), diff("s", "saving").alias("saved_tokens"))


# --- ends ---------------------------------------------------------------------------

def _digests(batches):
    """SHA-256 over the pieces of each node, in order."""
    key, h, out = None, None, []
    for b in batches:
        for r in b.to_pylist():
            here = (r["depth"], r["f1"], r["f2"])
            if here != key:
                if h:
                    out.append((*key, h.hexdigest()))
                key, h = here, hashlib.sha256(r["piece"].encode())
            else:
                h.update(b"," + r["piece"].encode())
        if out:
            yield _digest_rows(out)
            out = []
    if h:
        yield _digest_rows([(*key, h.hexdigest())])


def _digest_rows(rows) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                                      names=["depth", "f1", "f2", "ends_sha256"])


def _ends(prefixes: DataFrame, members: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    last = (prefixes.select("conv", "depth", "f1", "f2")
            .join(members.select("conv", F.col("n").alias("depth")), ["conv", "depth"])
            .unionByName(members.where("n = 0").select("conv", zero.alias("depth"), zero.alias("f1"), zero.alias("f2"))))
    pieces = (last.groupBy("depth", "f1", "f2", F.floor(F.col("conv") / GROUP).alias("piece_no"))       # at most GROUP ids
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("piece")))
    schema = StructType([StructField("depth", _L), StructField("f1", _L), StructField("f2", _L), StructField("ends_sha256", StringType())])
    return (pieces.repartition("depth", "f1", "f2").sortWithinPartitions("depth", "f1", "f2", "piece_no")
            .select("depth", "f1", "f2", "piece").mapInArrow(_digests, schema))


# --- the operator -----------------------------------------------------------------------

def prefix_trie(rows: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the trie over ``rows`` (conv, pos from 0, key, chars);
    ``members`` (conv, n) names every conversation with its number of turns."""
    ship(rows.sparkSession)
    members = settled(members)
    prefixes = written(_prefixes(rows), "trie-paths")
    nodes = settled(_nodes(prefixes, members))
    names = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"),
                         F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    children = settled(nodes.where("depth > 0").select("node", "depth", "p1", "p2").join(names, ["depth", "p1", "p2"])
                       .select("node", "parent", "parent_conv_id"))
    count = nodes.count()
    kids = settled(children.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.min("node").alias("first"),
                                                  F.max("node").alias("last")).withColumnRenamed("parent", "node"))
    full = settled(nodes.join(kids, "node", "left"))
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    down = full.select(enter("node").alias("arc"), F.coalesce(enter("first"), leave("node")).alias("next"))
    across = _siblings(children, count).select(leave("a").alias("arc"), enter("b").alias("next"))
    up = kids.select(leave("last").alias("arc"), leave("node").alias("next"))
    end = full.where("depth = 0").select(leave("node").alias("arc"), F.lit(-1).cast("long").alias("next"))
    tour = written(down.unionByName(across).unionByName(up).unionByName(end), "trie-tour")
    weights = full.select(enter("node").alias("arc"), F.col("first").isNull().cast("long").alias("leaf"), "saving")
    sums = _subtrees(tour, weights)
    ends = _ends(prefixes, members)
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return (full.join(children.select("node", "parent_conv_id"), "node", "left").join(sums, "node")
            .join(ends, ["depth", "f1", "f2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256")))
