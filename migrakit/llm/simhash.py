"""SimHash near-duplicates with vantage-point trees over Hamming distance.

1. Every text gets a 64-bit fingerprint from the XXH64 of its word shingles.
2. Equal fingerprints are one point.  A vantage-point tree of bounded depth,
   fitted on a bounded sample, cuts the Hamming space into leaves: a node has a
   vantage point v and a radius m, points with d(p, v) <= m go inside, others
   outside.  Every point has one home leaf.  By the triangle inequality two
   points within ``distance`` bits on either side of a node both lie within
   ``distance`` of its boundary, so an outer point near the boundary also visits
   the inner side as a guest, and a guest visits each side that its ball
   reaches.  A leaf thus sees every close pair of which one end is at home there.
3. A leaf searches its points exactly (cut further by the same rule, then block
   by block) and returns a spanning forest of the links, never all pairs.
4. Components of the links by large-star / small-star rounds, each written to
   the shared checkpoint folder.

Sizes: the tree has at most 2^``max_depth`` nodes of 9 bytes; the sample is at
most ``sample`` points; leaves aim at ``leaf`` points.  A leaf that outgrows that (more
points than the tree's depth can part, or a dense cluster) is searched in
groups of at most two chunks, every two chunks once, so no task gets it whole.  Copies of one text, however
many, are one point.  Guests grow as about N^0.68 per point for fingerprints
spread at random, the price of a radius of 3 in 64 bits.

Defined results: a text without words (null, empty) has fingerprint 0, linked
like any other; a text of fewer words than a shingle is one shingle; a row's
component is the smallest doc_id of its component, null if all are null;
repeated rows are each reported; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import packed_columns, settled, ship, written

SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half the shingles' XXH64."""
    words = text.lower().split()            # bytes: ASCII case and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for i in range(0, n, 65536):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i:i + 65536], stops[i:i + 65536])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """(row, rid, fp), written once: ``row`` holds the columns ``keep`` (default all),
    ``rid`` names the row, ``fp`` is the fingerprint as a signed long."""
    ship(docs.sparkSession)
    base = docs.select(packed_columns(docs, keep), F.monotonically_increasing_id().alias("rid"),
                       F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("raw"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["row", "rid", "fp"])

    schema = StructType([base.schema["row"], StructField("rid", LongType()), StructField("fp", LongType())])
    return written(base.mapInArrow(run, schema), "fingerprints")


# --- the tree ---------------------------------------------------------------

def _bits(a, b):
    return np.bitwise_count(a ^ b)


def best_split(points: np.ndarray, radius: int, rng, tries: int = 12):
    """(vantage, m) with the least expected work, or None if no cut helps.  The
    work of a side is its points times the points whose balls reach it."""
    best, out = 0.98, None
    for v in points[rng.integers(0, len(points), tries)]:
        below = np.cumsum(np.bincount(_bits(points, v), minlength=65)) / len(points)       # P(d <= m)
        reach_in = below[np.minimum(np.arange(65) + radius, 64)]
        reach_out = 1 - np.concatenate((np.zeros(radius), below))[:65]
        work = below * reach_in + (1 - below) * reach_out
        m = int(np.argmin(work))
        if work[m] < best:
            best, out = work[m], (v, m)
    return out


def build_tree(points: np.ndarray, radius: int, depth: int, seed: int = 7):
    """Heap-ordered arrays (vantage, m) of a tree of ``depth`` levels; m = -1
    sends everything outside (a node the sample cannot cut)."""
    rng = np.random.default_rng(seed)
    size = (1 << depth) - 1
    vantage, radii = np.zeros(size, np.uint64), np.full(size, -1, np.int8)
    todo = [(0, points)]
    while todo:
        node, pts = todo.pop()
        if node >= size or len(pts) < 8:
            continue
        cut = best_split(pts, radius, rng)
        if cut is None:
            continue
        vantage[node], radii[node] = cut
        inner = _bits(pts, cut[0]) <= cut[1]
        todo += [(2 * node + 1, pts[inner]), (2 * node + 2, pts[~inner])]
    return vantage, radii


def cut(points, home, v, m, radius):
    """(inner index, inner home, outer index, outer home) of points at a node."""
    d = _bits(points, v).astype(np.int16)
    inner = (d <= m) | (d <= m + radius)        # at home inside, or a ball that reaches inside
    outer = np.where(home, d > m, d > m - radius)
    inside = np.nonzero(inner)[0]
    outside = np.nonzero(outer)[0]
    return inside, home[inside] & (d[inside] <= m), outside, home[outside]


def route(points: np.ndarray, vantage, radii, radius: int):
    """(leaf, index of the point, at home) for every leaf a point visits."""
    leaves = []
    todo = [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if node >= len(radii):
            leaves.append((np.full(len(at), node - len(radii), np.int32), at, home))
        elif radii[node] < 0:
            todo.append((2 * node + 2, at, home))
        else:
            i, ih, o, oh = cut(points[at], home, vantage[node], int(radii[node]), radius)
            todo += [(2 * node + 1, at[i], ih), (2 * node + 2, at[o], oh)]
    return [np.concatenate(x) for x in zip(*leaves)]


def groups(leaves: np.ndarray, home: np.ndarray, points: np.ndarray, n_home: np.ndarray, n_guest: np.ndarray):
    """(index of the visit, a, b): the groups of its leaf that a visit goes to.

    A leaf's home points are cut into ``n_home[leaf]`` chunks and its guests into
    ``n_guest[leaf]``; there is a group for every two home chunks and for every home
    chunk with every guest chunk, so all pairs with an end at home meet and no group
    holds more than two chunks."""
    at, a, b = [], [], []

    def add(i, x, y):
        at.append(i)
        a.append(np.broadcast_to(np.asarray(x, np.int32), len(i)))
        b.append(np.broadcast_to(np.asarray(y, np.int32), len(i)))

    whole = (n_home[leaves] <= 1) & (n_guest[leaves] <= 1)
    add(np.nonzero(whole)[0], 0, 0)
    spread = (points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    for leaf in np.unique(leaves[~whole]):
        h, g = max(1, int(n_home[leaf])), int(n_guest[leaf])
        mine, guest = (np.nonzero((leaves == leaf) & x)[0] for x in (home, ~home))
        c, k = (spread[mine] % np.uint64(h)).astype(np.int32), (spread[guest] % np.uint64(max(g, 1))).astype(np.int32)
        for j in range(h):
            other = c != j
            add(mine[other], np.minimum(c[other], j), np.maximum(c[other], j))
            add(guest, j, h + k)
        for j in range(g):
            add(mine, c, h + j)
    return np.concatenate(at), np.concatenate(a), np.concatenate(b)


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the classes of the pairs (a, b); label[i] is always a root."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def leaf_links(points: np.ndarray, home: np.ndarray, radius: int, block: int = 2_000_000):
    """A spanning forest (child, root) of the links within ``radius`` that have an
    end at home: cut by vantage points while that helps, then block by block."""
    rng = np.random.default_rng(11)
    label = np.arange(len(points))
    todo = [(np.arange(len(points)), home)]
    while todo:
        at, h = todo.pop()
        mine = at[h]
        if not len(mine) or len(at) < 2:
            continue
        pair = best_split(points[mine], radius, rng) if len(mine) * len(at) > block and len(mine) > 64 else None
        if pair is not None:
            i, ih, o, oh = cut(points[at], h, *pair, radius)
            todo += [(at[i], ih), (at[o], oh)]
            continue
        step = max(1, block // len(at))
        for s in range(0, len(mine), step):
            a, b = np.nonzero(_bits(points[mine[s:s + step], None], points[at][None, :]) <= radius)
            _join(label, mine[s:s + step][a], at[b])
    child = np.nonzero(label != np.arange(len(points)))[0]
    return points[child], points[label[child]]


def links(nodes: DataFrame, distance: int = 3, leaf: int = 8192, sample: int = 100_000, max_depth: int = 14,
          chunk: int = 250_000) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column ``fp``): for every two
    within ``distance`` bits, a path of returned links.  Leaves that hold more than
    ``chunk`` points at home or as guests are searched in several groups."""
    spark = nodes.sparkSession
    ship(spark)
    n = nodes.count()
    depth = min(max_depth, max(0, int(np.ceil(np.log2(max(n, 1) / leaf)))))
    if depth:
        def grow(batches):
            pts = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in batches]).view(np.uint64)
            vantage, radii = build_tree(pts, distance, depth)
            yield pa.RecordBatch.from_arrays([pa.array(vantage.view(np.int64)), pa.array(radii.astype(np.int32))], ["v", "m"])

        drawn = nodes.orderBy(F.xxhash64("fp"), "fp").limit(sample).select("fp")
        tree = drawn.mapInArrow(grow, "v long, m int").toPandas()           # 2^max_depth rows at most
        vantage, radii = tree["v"].to_numpy().view(np.uint64), tree["m"].to_numpy()
    else:
        vantage, radii = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    shared = spark.sparkContext.broadcast((vantage, radii))

    def tally(batches):
        count = np.zeros((2, len(shared.value[1]) + 1), np.int64)
        for b in batches:
            pts = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if len(pts):
                leaves, _, home = route(pts, *shared.value, distance)
                count[0] += np.bincount(leaves[home], minlength=count.shape[1])
                count[1] += np.bincount(leaves[~home], minlength=count.shape[1])
        here = np.nonzero(count.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), pa.array(count[0][here]), pa.array(count[1][here])],
                                         ["leaf", "home", "guest"])

    sizes = (nodes.select("fp").mapInArrow(tally, "leaf int, home long, guest long").groupBy("leaf")
             .agg(F.sum("home").alias("home"), F.sum("guest").alias("guest")).toPandas())       # 2^max_depth rows at most
    chunks = np.zeros((2, len(radii) + 1), np.int64)
    for i, kind in enumerate(("home", "guest")):
        chunks[i][sizes["leaf"].to_numpy(np.int64)] = -(-sizes[kind].to_numpy(np.int64) // chunk)
    cuts = spark.sparkContext.broadcast(chunks)

    def visit(batches):
        for b in batches:
            pts = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if len(pts):
                leaves, at, home = route(pts, *shared.value, distance)
                i, x, y = groups(leaves, home, pts[at], *cuts.value)
                yield pa.RecordBatch.from_arrays([pa.array(leaves[i]), pa.array(x), pa.array(y), pa.array(pts[at][i].view(np.int64)),
                                                  pa.array(home[i])], ["leaf", "a", "b", "fp", "home"])

    def search(group: pa.Table) -> pa.Table:
        pts = group.column("fp").to_numpy().view(np.uint64)
        u, v = leaf_links(pts, group.column("home").to_numpy(), distance)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    visits = nodes.select("fp").mapInArrow(visit, "leaf int, a int, b int, fp long, home boolean")
    return visits.groupBy("leaf", "a", "b").applyInArrow(search, "u long, v long")


# --- components ----------------------------------------------------------------

def _toward(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller end, each once, settled."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return settled(e.where(F.col("u") != F.col("v")).distinct())


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): every point of a component but its smallest, with the smallest.

    Large-star and small-star rounds over distributed edges.  A hub's rows meet
    its minimum in a join of two plain shuffles, which AQE splits."""
    e = _toward(edges)
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settled(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")))
        e = _toward(both.join(low, "u").where(F.col("v") > F.col("u")).select("v", F.col("low").alias("u")))
        low = settled(e.groupBy("u").agg(F.min("v").alias("low")))
        e = _toward(e.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("low").alias("v")))
        state = e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return e
        seen = state


def components(rows: DataFrame, distance: int = 3, **tree) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``rows`` (row,
    rid, fp): the smallest fingerprint and the smallest doc_id of its component."""
    points = settled(rows.groupBy("fp").agg(F.min("row.doc_id").alias("doc_id")))
    found = stars(links(points, distance, **tree))
    whole = settled(found.select(F.col("u").alias("fp"), F.col("v").alias("root"))
                    .union(found.select("v", "v")).distinct())
    named = points.join(whole, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc_id")
    named = settled(named)
    least = settled(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return settled(named.join(least, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, keep: list[str] | None = None,
                    **tree) -> DataFrame:
    """(row, rid, fp, root, component_id) of every row."""
    rows = fingerprints(docs, shingle, keep)
    return rows.join(components(rows, distance, **tree), "fp")


def dedup(docs: DataFrame, shingle: int = 3, distance: int = 3, **tree) -> DataFrame:
    """One document of each component stays: the smallest doc_id (null last), of
    its repeated rows any one."""
    rows = fingerprints(docs, shingle)
    slim = rows.select("fp", "rid", F.col("row.doc_id").alias("doc_id"))
    found = slim.join(components(rows, distance, **tree), "fp")
    # min of a struct: null doc_id last, then doc_id, then the row's own name.
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first"))
    return rows.join(stay.select("first.rid"), "rid", "left_semi").select("row.*")
