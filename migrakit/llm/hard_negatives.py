"""Hard negatives by exact search in an STR-packed R-tree.

Rows are integer vectors with a label.  For every anchor the best other rows of
its label are its positives; for every positive, the best rows of other labels
whose score (inner product with the anchor) lies in a window given in percent of
the positive's score are its hard negatives.

* **Packing.**  Sort-Tile-Recursive with two slabs per coordinate (what STR's
  P**(1/d) gives in many dimensions), coordinates by falling spread: the cuts
  that deal rows over chunks are fitted on at most about ``SAMPLE`` rows, every
  row is then dealt, and a chunk is packed the same way into leaves of
  ``LEAF`` rows under nodes of ``FANOUT``.  A tile with too many rows (copies of
  one vector cannot be cut) is split by a hash of the row number.
* **Boxes.**  Against a minimum bounding box, each coordinate of an anchor
  gives an interval of products; their sums bound every score inside.
* **Search.**  A block of queries shares a best-first queue.  A box is pruned
  for a query if its interval misses the score window or ends strictly below the
  query's k-th best so far; a tie is visited, since the smaller id wins.  The
  k-th best starts from the sampled rows (real rows, so a valid bound), which
  also decides which chunks a query is sent to.

A task holds one chunk and a block of queries at a time.  Chunks number about
the square root of the rows / 16 (at most 8,192), so their boxes stay small
enough to send to every task, and a query visits a chunk at most once.

Defined results: rows with a null id, label, vector or component take no part,
nor does a row with a component so large that scores could exceed 64 bits;
vectors of different length are not compared; equal rows are separate rows, each
the other's neighbour; ties go to the smaller id; an empty table or one without
anchors gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import settled, ship, written

#: Rows (expected) that fit the cuts and seed the bounds; rows of a leaf; nodes under a node; queries that share a queue.
SAMPLE, LEAF, FANOUT, BLOCK, MOST_CHUNKS = 32_768, 64, 16, 64, 8192

_L, _I, _V = LongType(), IntegerType(), ArrayType(LongType())
_BOX = StructType([StructField("chunk", _I), StructField("low", _V), StructField("high", _V)])
_QUERY = StructType([StructField("anchor", _L), StructField("mark", _L), StructField("label", _L), StructField("same", BooleanType()),
                     StructField("lo", _L), StructField("hi", _L), StructField("near", _I), StructField("v", _V)])
_SENT = StructType([*_QUERY.fields, StructField("kth", _L), StructField("kth_id", _L), StructField("chunk", _I)])
_FOUND = StructType([StructField("anchor", _L), StructField("mark", _L), StructField("score", _L), StructField("id", _L)])
_MIN, _MAX = -(1 << 63), (1 << 63) - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as a double; null where x is null,
    NaN or infinite."""
    def one(x):
        d = x.cast("double")
        return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), F.floor(d * float(scale)))
    return F.transform(vector, one)


# --- boxes, tiles, trees (numpy) ----------------------------------------------

def _vectors(col) -> np.ndarray:
    """An Arrow list column of one length as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _kind(d: int, *most: int):
    """A type in which inner products are exact; the two floats go through BLAS."""
    top = max(d, 1)
    for m in most:
        top *= max(int(m), 1)
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64


def _reach(v: np.ndarray) -> int:
    return max(int(v.max(initial=0)), -int(v.min(initial=0)))


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Least and greatest inner product of each query with anything in each box:
    per coordinate an interval, by the sign of the query's component."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def cuts(sample: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """STR with two slabs per coordinate: (coordinate, median of every node) per
    level, coordinates by falling spread."""
    if not sample.size:
        return []
    order = np.argsort(-sample.astype(np.float64).var(axis=0), kind="stable")
    at, out = np.zeros(len(sample), np.int64), []
    for level in range(depth):
        c = int(order[level % len(order)])
        medians = np.zeros(1 << level, np.int64)
        for node in range(1 << level):
            x = sample[at == node, c]
            if len(x):
                medians[node] = np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]
        out.append((c, medians))
        at = 2 * at + (sample[:, c] > medians[at])
    return out


def tile(v: np.ndarray, tree) -> np.ndarray:
    at = np.zeros(len(v), np.int64)
    for c, medians in tree:
        at = 2 * at + (v[:, c] > medians[at])
    return at


class RTree:
    """An STR-packed R-tree over the rows of one chunk."""

    def __init__(self, ids, uids, labels, v):
        order = self._pack(v)
        self.v, self.ids, self.uids, self.labels = v[order], ids[order], uids[order], labels[order]
        edge = np.arange(0, len(v), LEAF)
        self.levels = [(np.minimum.reduceat(self.v, edge), np.maximum.reduceat(self.v, edge))]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            edge = np.arange(0, len(low), FANOUT)
            self.levels.append((np.minimum.reduceat(low, edge), np.maximum.reduceat(high, edge)))
        self.reach = _reach(v)

    @staticmethod
    def _pack(v: np.ndarray) -> np.ndarray:
        coordinates = np.argsort(-v.astype(np.float64).var(axis=0), kind="stable") if v.shape[1] else []
        order = np.arange(len(v))
        todo = [(0, len(v), 0)] if v.shape[1] else []
        while todo:
            a, b, level = todo.pop()
            leaves = -(-(b - a) // LEAF)
            if leaves < 2:
                continue
            mid = a + (leaves // 2) * LEAF
            x = v[order[a:b], coordinates[level % len(coordinates)]]
            order[a:b] = order[a:b][np.argpartition(x, mid - a)]
            todo += [(a, mid, level + 1), (mid, b, level + 1)]
        return order

    def search(self, q, label, same, lo, hi, own, kth, kth_id, k: int):
        """Best-first search of a block of queries: per query the scores and ids of
        its k best rows here, as far as they beat its k-th best."""
        dtype = _kind(q.shape[1], _reach(q), self.reach)
        q, v = q.astype(dtype), self.v.astype(dtype, copy=False)
        kth, kth_id = kth.copy(), kth_id.copy()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
        tick, everyone = count(), np.arange(len(q))
        queue = [(0.0, next(tick), len(self.levels), 0, everyone, np.full(len(q), _MAX))]

        def wanted(top, low_score, i):
            return (top >= np.maximum(kth[i], lo[i])) & (low_score <= hi[i])

        while queue:
            _, _, level, node, who, top = heapq.heappop(queue)
            who = who[top >= np.maximum(kth[who], lo[who])]        # bounds have risen since it was queued
            if not len(who):
                continue
            if level > 0:
                low, high = self.levels[level - 1]
                a, b = (0, len(low)) if level == len(self.levels) else (node * FANOUT, min((node + 1) * FANOUT, len(low)))
                least, most = bounds(q[who], low[a:b].astype(dtype), high[a:b].astype(dtype))
                least, most = least.astype(np.int64), most.astype(np.int64)
                for j in range(b - a):
                    ok = wanted(most[:, j], least[:, j], who)
                    if ok.any():
                        t = most[ok, j]
                        slack = float((t.astype(np.float64) - np.maximum(kth[who[ok]], lo[who[ok]]).astype(np.float64)).max())
                        heapq.heappush(queue, (-slack, next(tick), level - 1, a + j, who[ok], t))
                continue
            a, b = node * LEAF, min((node + 1) * LEAF, len(v))
            s = (q[who] @ v[a:b].T).astype(np.int64)
            ids = self.ids[a:b]
            ok = ((self.labels[a:b][None, :] == label[who][:, None]) == same[who][:, None]) \
                & (s >= lo[who][:, None]) & (s <= hi[who][:, None]) & (self.uids[a:b][None, :] != own[who][:, None]) \
                & ((s > kth[who][:, None]) | ((s == kth[who][:, None]) & (ids[None, :] <= kth_id[who][:, None])))
            for i in np.flatnonzero(ok.any(axis=1)):
                w = who[i]
                score, rid = np.r_[best[w][0], s[i, ok[i]]], np.r_[best[w][1], ids[ok[i]]]
                top_k = np.lexsort((rid, -score))[:k]
                best[w] = (score[top_k], rid[top_k])
                if len(top_k) == k:
                    kth[w], kth_id[w] = score[top_k[-1]], rid[top_k[-1]]
        return best


# --- tasks ---------------------------------------------------------------------

def _by_length(col) -> list[np.ndarray]:
    n = np.asarray(pc.list_value_length(col))
    return [np.flatnonzero(n == d) for d in np.unique(n)]


def _tiles(trees: dict[int, list]):
    """Adds every row's tile."""
    def run(batches):
        for b in batches:
            v, out = b.column("v"), np.zeros(b.num_rows, np.int32)
            for rows in _by_length(v):
                part = _vectors(v.take(pa.array(rows)))
                out[rows] = tile(part, trees.get(part.shape[1], []))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "tile"])
    return run


def _boxes(batches):
    """One box per chunk and batch."""
    for b in batches:
        if not b.num_rows:
            continue
        chunk, v, out = np.asarray(b.column("chunk")), b.column("v"), []
        for c in np.unique(chunk):
            part = _vectors(v.take(pa.array(np.flatnonzero(chunk == c))))
            out.append((int(c), part.min(axis=0).tolist(), part.max(axis=0).tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))],
                                         names=_BOX.names)


def _merge_boxes(t: pa.Table) -> pa.Table:
    low, high = _vectors(t.column("low")).min(axis=0), _vectors(t.column("high")).max(axis=0)
    return pa.table([pa.array([t.column("chunk")[0].as_py()], pa.int32()), pa.array([low.tolist()], pa.list_(pa.int64())),
                     pa.array([high.tolist()], pa.list_(pa.int64()))], names=_BOX.names)


def _route(shared, k: int):
    """Seeds every query's k-th best from the sample, then sends it to the chunks
    whose boxes its window and its k-th best do not rule out."""
    def run(batches):
        model = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            label, same, lo, hi, own = (np.asarray(b.column(c)) for c in ("label", "same", "lo", "hi", "anchor"))
            same = same.astype(bool)
            for rows in _by_length(b.column("v")):
                q = _vectors(b.column("v").take(pa.array(rows)))
                m = model.get(q.shape[1])
                if m is None:
                    continue
                dtype = _kind(q.shape[1], _reach(q), m["reach"])
                kth, kth_id = np.full(len(rows), _MIN), np.full(len(rows), _MAX)
                for a in range(0, len(rows), 256):
                    part = rows[a:a + 256]
                    s = (q[a:a + 256].astype(dtype) @ m["v"].astype(dtype).T).astype(np.int64)
                    ok = ((m["label"][None, :] == label[part][:, None]) == same[part][:, None]) & (s >= lo[part][:, None]) \
                        & (s <= hi[part][:, None]) & (m["uid"][None, :] != own[part][:, None])
                    for i in np.flatnonzero(ok.sum(axis=1) >= k):
                        at = np.flatnonzero(ok[i])
                        at = at[np.lexsort((m["id"][at], -s[i, at]))[k - 1]]
                        kth[a + i], kth_id[a + i] = s[i, at], m["id"][at]
                least, most = bounds(q.astype(dtype), m["low"].astype(dtype), m["high"].astype(dtype))
                go = (most.astype(np.int64) >= np.maximum(kth, lo[rows])[:, None]) & (least.astype(np.int64) <= hi[rows][:, None])
                i, j = np.nonzero(go)
                for a in range(0, len(i), 8192):
                    x, y = i[a:a + 8192], j[a:a + 8192]
                    part = b.take(pa.array(rows[x]))
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in _QUERY.names], pa.array(kth[x]), pa.array(kth_id[x]),
                                                      pa.array(m["chunk"][y].astype(np.int32))], names=_SENT.names)
    return run


def _search(k: int):
    """Rows sorted by chunk, the chunk's points before its queries."""
    def run(batches):
        chunk, points, tree = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            chunks, kind = np.asarray(b.column("chunk")), np.asarray(b.column("kind"))
            edge = np.flatnonzero(np.r_[True, (chunks[1:] != chunks[:-1]) | (kind[1:] != kind[:-1])])
            for a, z in zip(edge, np.r_[edge[1:], len(chunks)]):
                if chunks[a] != chunk:
                    chunk, points, tree = chunks[a], [], None
                part = b.slice(a, z - a)
                if kind[a] == 0:
                    points.append((*(np.asarray(part.column(c)) for c in ("id", "anchor", "label")), _vectors(part.column("v"))))
                    continue
                if not points:
                    continue
                if tree is None:
                    ids, uids, labels, v = (np.concatenate(x) for x in zip(*points))
                    tree = RTree(ids, uids, labels, v)
                q = _vectors(part.column("v"))
                cols = [np.asarray(part.column(c)) for c in ("label", "same", "lo", "hi", "anchor", "kth", "kth_id", "mark")]
                for i in range(0, len(q), BLOCK):
                    label, same, lo, hi, own, kth, kth_id, mark = (c[i:i + BLOCK] for c in cols)
                    best = tree.search(q[i:i + BLOCK], label, same.astype(bool), lo, hi, own, kth, kth_id, k)
                    n = [len(s) for s, _ in best]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(np.repeat(mark, n)),
                                                      pa.array(np.concatenate([s for s, _ in best])),
                                                      pa.array(np.concatenate([r for _, r in best]))], names=_FOUND.names)
    return run


# --- the operator ----------------------------------------------------------------

class Index:
    """All rows dealt over chunks, with the chunks' boxes and the sample."""

    def __init__(self, rows: DataFrame):
        self.spark = spark = rows.sparkSession
        ship(spark)
        base = written(rows.withColumn("anchor", F.monotonically_increasing_id()), "hard-negatives-rows")
        sizes = {r["d"]: r["n"] for r in base.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(sizes.values())
        want = max(1, min(MOST_CHUNKS // 2, int(total ** 0.5 / 16)))
        fit = base.where(F.pmod(F.xxhash64("anchor"), F.lit(max(total, 1))) < SAMPLE).select("anchor", "id", "label", "v").toArrow()
        lengths = fit.column("v").combine_chunks()
        rows_of = {len(lengths[int(r[0])]): r for r in _by_length(lengths)}
        trees, self.model, first, at = {}, {}, {}, 0
        for d, n in sorted(sizes.items()):
            part = fit.take(pa.array(rows_of.get(d, np.zeros(0, np.int64))))
            sample = _vectors(part.column("v")).reshape(-1, d) if part.num_rows else np.zeros((0, d), np.int64)
            depth = max(0, int(np.ceil(np.log2(max(1.0, want * n / max(total, 1))))))
            trees[d] = cuts(sample, depth) if d and len(sample) else []
            first[d], at = at, at + (1 << len(trees[d]))
            self.model[d] = {"v": sample, **{x: part.column(y).to_numpy() for x, y in (("uid", "anchor"), ("id", "id"), ("label", "label"))}}
        tiled = base.mapInArrow(_tiles(trees), StructType([*base.schema.fields, StructField("tile", _I)]))
        starts = spark.createDataFrame([(d, a) for d, a in first.items()] or [(0, 0)], "d int, start int")
        tiled = tiled.join(F.broadcast(starts), F.size("v") == F.col("d")).withColumn("tile", F.col("tile") + F.col("start"))
        tiled = written(tiled.drop("d", "start"), "hard-negatives-tiles")
        # At most one row per tile; tiles and their splits are bounded by MOST_CHUNKS (and the number of lengths).
        room = max(1, 2 * -(-total // want))
        splits, at = [], 0
        for r in tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).orderBy("tile").collect():
            splits.append((r["tile"], at, -(-r["n"] // room)))
            at += splits[-1][2]
        splits = spark.createDataFrame(splits or [(0, 0, 1)], "tile int, base int, parts int")
        chunk = (F.col("base") + F.pmod(F.xxhash64("anchor"), F.col("parts"))).cast("int")
        self.rows = written(tiled.join(F.broadcast(splits), "tile").withColumn("chunk", chunk).drop("base", "parts", "tile"),
                            "hard-negatives-chunks")
        boxes = self.rows.select("chunk", "v").mapInArrow(_boxes, _BOX).groupBy("chunk").applyInArrow(_merge_boxes, _BOX)
        for r in boxes.collect():
            m = self.model[len(r["low"])]
            for name, x in (("low", r["low"]), ("high", r["high"]), ("chunk", r["chunk"])):
                m.setdefault(name, []).append(x)
        for d, m in self.model.items():
            for name in ("low", "high", "chunk"):
                m[name] = np.array(m[name], np.int64)
            m["reach"] = max(_reach(m["low"]), _reach(m["high"]))
        self.shared = spark.sparkContext.broadcast(self.model)

    def best(self, queries: DataFrame, k: int) -> DataFrame:
        """(anchor, mark, score, id, rank): the k best rows of every query, named
        by ``anchor`` and ``mark``."""
        sent = queries.select(*_QUERY.names).mapInArrow(_route(self.shared, k), _SENT)
        null = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in _SENT.fields}
        points = self.rows.select("chunk", F.lit(0).alias("kind"), "id", "anchor", "label", "v",
                                  *[null[c] for c in ("mark", "same", "lo", "hi", "near", "kth", "kth_id")])
        both = points.unionByName(sent.withColumn("kind", F.lit(1)).withColumn("id", F.lit(None).cast("long")))
        both = both.repartition("chunk").sortWithinPartitions("chunk", "kind", "near", "anchor")
        found = both.mapInArrow(_search(k), _FOUND)
        order = Window.partitionBy("anchor", "mark").orderBy(F.desc("score"), F.asc("id"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
         id: str = "vec_id", label: str = "label", vector: str = "vector") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).
    ``rows`` holds integer vectors; ``anchor`` tells which rows are anchors; a
    negative's score is between the two percentages of its positive's."""
    most = F.floor(F.sqrt(F.lit(9.2e18) / F.greatest(F.size(vector), F.lit(1))))
    whole = F.forall(vector, lambda x: x.isNotNull() & x.between(-most, most))
    rows = (rows.where(F.col(id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & whole)
            .select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                    F.coalesce(anchor, F.lit(False)).alias("is_anchor"), F.col(vector).cast("array<bigint>").alias("v")))
    index = Index(rows)
    low, high = F.lit(_MIN), F.lit(_MAX)
    anchors = index.rows.where("is_anchor").select("anchor", "id", "label", F.col("chunk").alias("near"), "v")
    near = settled(index.best(anchors.select("*", F.lit(0).cast("long").alias("mark"), F.lit(True).alias("same"),
                                             low.alias("lo"), high.alias("hi")), positives))
    percent = lambda p, round_: round_(F.col("score").cast("decimal(20,0)") * F.lit(p) / F.lit(100)).cast("long")
    asked = (near.select("anchor", "score").distinct()                       # equal scores ask the same
             .select("anchor", F.col("score").alias("mark"), percent(window[0], F.ceil).alias("lo"),
                     percent(window[1], F.floor).alias("hi")).where("lo <= hi"))
    queries = asked.join(anchors, "anchor").withColumn("same", F.lit(False))
    far = index.best(queries, negatives)
    ids = anchors.select("anchor", F.col("id").alias("anchor_id"))
    pairs = near.select("anchor", F.col("score").alias("positive_score"), F.col("id").alias("positive_id")).join(ids, "anchor")
    far = far.select("anchor", F.col("mark").alias("positive_score"), "rank", F.col("id").alias("negative_id"),
                     F.col("score").alias("negative_score"))
    return (pairs.join(far, ["anchor", "positive_score"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
