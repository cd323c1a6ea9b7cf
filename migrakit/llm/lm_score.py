"""Language-model scoring by context-tree weighting over bytes.

A text is its words in lower case (A-Z), each followed by a space, then an end
byte.  A byte is coded as eight binary decisions; a decision's contexts are the
0 to ``depth`` bytes before it.  Every node (context, decisions so far) has a
Krichevsky-Trofimov estimate of its two counts, and a weight: with KT the
probability that the estimate gave the training data at the node and Pw the
mixture of KT with the product of its children's Pw, one half each, the node's
own estimate has weight KT / (2 Pw) and deeper contexts have the rest.  A text's
score is the sum of log10 of the mixed probabilities; its code length per byte
is -score * log2(10) / bytes.

How it runs.  Texts are cut once into blocks (a dictionary of words and a code
per token), written to the shared folder.  A block's long columns are compressed
bytes, opened in a task one block at a time: what the JVM holds of a block is about
half its text, not an array element per token.  Counts of byte strings of
depth + 1 bytes are summed per task and shuffled: what is gathered grows with
the corpus.  The tree is built where the counts lie, partitioned by the first
``GROUP`` context bytes, and every distinct byte string of all texts, held-out
ones included, is answered there, where the whole subtree is; only the part
above that (at most 256^GROUP contexts) is put together on the driver and sent
to tasks.  No part of the tree is left out: a task works on whole subtrees,
about ``max_nodes`` nodes at a time.  The ``max_known`` answers asked for most
often are sent to tasks, the others are joined back by byte string and block.
``least`` is the number of times that a context must be seen to give an estimate: 1,
the default, is context-tree weighting over all depths; at 2 a context seen once is
answered by the next shorter one alone.

Word counts for the base score are looked up per block and distinct word, not
per token: one shuffle by word, where a window adds up its training count, and
one back by block.  No vocabulary is broadcast.

Defined results: a null or empty text is the end byte alone; a null doc_id
hashes like an empty text; without training rows every count is 0 and the score
is that of an even coin per decision; repeated rows are each scored; an empty
table gives no rows.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .common import packed_columns, ship, whole_text, written

END = 10
GROUP = 3
#: Bytes of text in a block, at most (a longer text is a block of its own).
BLOCK = 16 << 20
#: Tokens worked on at a time.
PIECE = 1 << 15


# --- blocks -------------------------------------------------------------------

def _block(raws):
    """(words, codes, tokens per text): words end with their space; the end of a
    text is the word "\\n"."""
    codes, at, counts = [], {b"\n": 0}, []
    for raw in raws:
        words = raw.lower().split()              # bytes: ASCII case and white space only
        codes.append(np.fromiter((at.setdefault(w, len(at)) for w in words), np.int32, len(words)))
        codes.append(np.zeros(1, np.int32))
        counts.append(len(words) + 1)
    words = [b"\n"] + [w + b" " for w in list(at)[1:]]
    return words, np.concatenate(codes), np.array(counts, np.int32)


def _packed(a) -> bytes:
    """An array as compressed bytes."""
    a, sink = a if isinstance(a, pa.Array) else pa.array(a), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("a", a.type)]), options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as w:
        w.write_batch(pa.record_batch([a], names=["a"]))
    return sink.getvalue().to_pybytes()


def _opened(packed: pa.BinaryScalar) -> pa.Array:
    return pa.ipc.open_stream(packed.as_buffer()).read_next_batch().column(0)


def _give_back() -> None:
    """Returns memory that was freed to the system: glibc keeps it, and a worker waits for
    its next task beside a JVM that needs it."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def blocks(docs: DataFrame, held_out) -> DataFrame:
    """(row, block, learned, held, words, train, codes, tokens), written once.  ``row``
    are the packed rows of the texts, ``learned`` the tokens of training texts,
    ``train`` the words' counts there; from ``held`` on the columns are ``_packed``."""
    ship(docs.sparkSession)
    base = docs.select(packed_columns(docs, [c for c in docs.columns if c != "text"]), held_out.alias("held"),
                       F.encode(whole_text("text"), "UTF-8").alias("raw"))
    kind = base.schema["row"].dataType
    schema = StructType([StructField("row", ArrayType(kind)), *StructType.fromDDL(
        "block long, learned long, held binary, words binary, train binary, codes binary, tokens binary").fields])

    def run(batches):
        from pyspark import TaskContext

        number, parts, size = TaskContext.get().partitionId() << 32, [], 0

        def made():
            row = pa.concat_arrays([p.column(0) for p in parts])
            held = np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p in parts]).astype(bool)
            words, codes, counts = _block(t.as_py() for p in parts for t in p.column(2))
            train = np.bincount(codes[np.repeat(~held, counts)], minlength=len(words)).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row), pa.array([number], pa.int64()), pa.array([int(train.sum())], pa.int64()),
                 *[pa.array([_packed(a)], pa.binary()) for a in (held, pa.array(words, pa.binary()), train, codes, counts)]], names=schema.names)

        for b in batches:
            ends = np.cumsum(pa.compute.binary_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < b.num_rows:
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + BLOCK - size, "right")))
                parts.append(b.slice(start, stop - start))
                size += int(ends[stop - 1] - done)
                start = stop
                if size >= BLOCK or start < b.num_rows:
                    yield made()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield made()
        _give_back()

    # A file a block: what a task reads goes to Python in one Arrow batch, which lies outside the heap more than once.
    return written(base.mapInArrow(run, schema), "lm-blocks", maxRecordsPerFile=1)


def _grams(stream: np.ndarray, depth: int) -> np.ndarray:
    """Of every byte from ``depth`` on: the bytes before it, the nearest first, then
    the byte, as one number; so contexts of every depth are leading bytes."""
    n = len(stream) - depth
    g = np.zeros(n, np.uint64)
    for i in range(depth - 1, -1, -1):
        g <<= np.uint64(8)
        g |= stream[i:i + n]
    g <<= np.uint64(8)
    g |= stream[depth:]
    return g


def _pieces(words, codes: np.ndarray, tokens: np.ndarray, depth: int):
    """(gram, text) of every byte of a block, ``PIECE`` tokens at a time: a text begins
    after ``depth`` end bytes, a piece inside a text after the bytes before it."""
    of = np.repeat(np.arange(len(tokens), dtype=np.int32), tokens)
    tail = None
    for s in range(0, len(codes), PIECE):
        taken = words.take(pa.array(codes[s:s + PIECE]))
        offsets = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset:taken.offset + len(taken) + 1]
        data = np.frombuffer(taken.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        text = np.repeat(of[s:s + PIECE], np.diff(offsets))
        at = np.arange(len(data)) + depth * (text - text[0])
        stream = np.full(at[-1] + 1 + depth, END, np.uint8)
        stream[at + depth] = data
        if s and of[s] == of[s - 1]:
            stream[:depth] = tail
        tail = stream[-depth:].copy()
        yield _grams(stream, depth)[at], text


# --- the tree -------------------------------------------------------------------

def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series at x + 8, brought back by 8 steps."""
    down = np.zeros_like(x)
    for i in range(8):
        down += np.log(x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - down


_SMALL = np.arange(1 << 12)
_HALVES, _WHOLES = _lgamma(_SMALL + 0.5), _lgamma(_SMALL + 1.0)


def _lgamma_from(table: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log Gamma(n + table's offset), looked up for small counts."""
    out = table[np.minimum(n, len(table) - 1)]
    big = np.nonzero(n >= len(table))[0]
    out[big] = _lgamma(n[big] + (0.5 if table is _HALVES else 1.0))
    return out


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma_from(_HALVES, a) + _lgamma_from(_HALVES, b) - _lgamma_from(_WHOLES, a + b) - 1.1447298858494002     # 2 log Gamma(1/2)


def _sums(keys: np.ndarray, n: np.ndarray):
    """Sums of n over equal neighbours: (keys, sums)."""
    first = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0] if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(n, first) if len(first) else n[:0])


def level(key: np.ndarray, n: np.ndarray, below=None):
    """Nodes of one depth from its sorted (context << 8 | byte) and counts.
    ``below``: (node key of this depth, log Pw) of the children.  Returns sorted
    arrays: node key (context << 8 | 1 and the decisions so far), probability of 1,
    own weight, log Pw, and the context's count."""
    ctx, byte = key >> np.uint64(8), key & np.uint64(255)
    uctx, total = _sums(ctx, n)
    out = []
    for j in range(8):
        bit = (byte >> np.uint64(7 - j)) & np.uint64(1)
        node = (ctx << np.uint64(8)) | np.uint64(1 << j) | (byte >> np.uint64(8 - j))
        nodes, ones = _sums(node, np.where(bit == 1, n, 0))
        both = _sums(node, n)[1]
        out.append((nodes, both - ones, ones))
    nodes = np.concatenate([o[0] for o in out])
    zeros, ones = (np.concatenate([o[i] for o in out]) for i in (1, 2))
    order = np.argsort(nodes, kind="stable")
    nodes, zeros, ones = nodes[order], zeros[order], ones[order]
    kt = _log_kt(zeros, ones)
    if below is None:
        own, pw = np.ones(len(nodes)), kt
    else:
        deep = np.bincount(np.searchsorted(nodes, below[0]), weights=below[1], minlength=len(nodes))
        own = 1 / (1 + np.exp(np.clip(deep - kt, -700, 700)))
        pw = np.logaddexp(kt, deep) - np.log(2)
    return {"key": nodes, "one": (ones + 0.5) / (zeros + ones + 1), "own": own, "pw": pw,
            "n": total[np.searchsorted(uctx, nodes >> np.uint64(8))]}


def _parents(nodes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Node keys one byte of context shorter, with log Pw."""
    key = nodes["key"]
    return ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(255)), nodes["pw"]


def levels(gram: np.ndarray, n: np.ndarray, depth: int, low: int, below=None):
    """Yields (d, nodes) from ``depth`` down to ``low`` of sorted grams of ``depth``
    context bytes."""
    for d in range(depth, low - 1, -1):
        shift = np.uint64(8 * (depth - d) + 8)
        if d < depth:
            key = ((gram >> shift) << np.uint64(8)) | (gram & np.uint64(255))
            order = np.argsort(key, kind="stable")
            key, count = _sums(key[order], n[order])
        else:
            key, count = _sums(gram, n)
        nodes = level(key, count, below)
        yield d, nodes
        below = _parents(nodes)


def _bits(grams: np.ndarray, tree: list, depth: int, start: float = 0.5, found_below: bool = False):
    """Mixed probabilities of the eight bits of every gram's byte after its context, from
    ``start``: what the contexts below the tree say, if ``found_below``."""
    byte = grams & np.uint64(255)
    for j in range(8):
        prefix = np.uint64(1 << j) | (byte >> np.uint64(8 - j))
        bit = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        p, deeper = np.full(len(grams), start), np.full(len(grams), found_below)
        for d in range(depth, -1, -1):
            keys, one, own = tree[d]
            if not len(keys):
                continue
            key = ((grams >> np.uint64(8 * (depth - d) + 8)) << np.uint64(8)) | prefix
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            found = keys[at] == key
            here, w = one[at], np.where(deeper, own[at], 1.0)
            here = np.where(bit, here, 1 - here)
            p = np.where(found, w * here + (1 - w) * p, p)
            deeper |= found
        yield p


def evaluate(grams: np.ndarray, tree: list, depth: int) -> np.ndarray:
    """log10 of the mixed probability of every gram's byte after its context."""
    return sum((np.log10(p) for p in _bits(grams, tree, depth)), np.zeros(len(grams)))


def _starts(keys: np.ndarray):
    """Of sorted keys: where each distinct one begins, and every key's place among them."""
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    return np.nonzero(first)[0], np.cumsum(first) - 1


def subtrees(gram: np.ndarray, n: np.ndarray, depth: int, low: int, least: int):
    """Whole subtrees of depth ``low`` >= 1 from their sorted distinct grams and counts (0:
    not seen in training).  Returns the mixed probabilities (8, grams) of the grams'
    bits by the contexts from depth ``low`` down, NaN where none was seen ``least``
    times, and (node key, log Pw) of the nodes of depth ``low``."""
    p, deeper = np.full((8, len(gram)), 0.5), np.zeros((8, len(gram)), bool)
    key, count, of, up, below = gram, n, np.arange(len(gram)), None, None
    for d in range(depth, low - 1, -1):
        if d < depth:
            short = ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(255))
            order = np.argsort(short, kind="stable")
            at, place = _starts(short[order])
            up = np.empty(len(short), np.int64)
            up[order] = place
            key, count, of = short[order][at], np.add.reduceat(count[order], at), up[of]
        at, place = _starts(key >> np.uint64(8))
        often = (np.add.reduceat(count, at) >= least)[place]
        byte, nodes, kept = key & np.uint64(255), [], []
        for j in range(8):
            node = (key ^ byte) | np.uint64(1 << j) | (byte >> np.uint64(8 - j))
            bit = (byte >> np.uint64(7 - j)) & np.uint64(1) == 1
            at, place = _starts(node)
            both, ones = np.add.reduceat(count, at), np.add.reduceat(np.where(bit, count, 0), at)
            kt = _log_kt(both - ones, ones)
            if below is None:
                own, pw = np.ones(len(at)), kt
            else:
                deep = np.bincount(place[up[below[j][0]]], weights=below[j][1], minlength=len(at))
                own = 1 / (1 + np.exp(np.clip(deep - kt, -700, 700)))
                pw = np.logaddexp(kt, deep) - np.log(2)
            kept.append((at, pw))
            nodes.append((node[at][both > 0], pw[both > 0]))
            i, one = place[of], (ones + 0.5) / (both + 1)
            here = np.where(bit[of], one[i], 1 - one[i])
            found, w = ((both > 0) & often[at])[i], np.where(deeper[j], own[i], 1.0)
            p[j] = np.where(found, w * here + (1 - w) * p[j], p[j])
            deeper[j] |= found
        below = kept
    return np.where(deeper, p, np.nan), tuple(np.concatenate(x) for x in zip(*nodes))


def _histogram_floor(counts: dict[int, int], most: int) -> int:
    """Smallest power of two such that the rows of at least that count are at most
    ``most``; ``counts``: rows by floor(log2(count))."""
    low, total = max(counts, default=0) + 1, 0
    for b in sorted(counts, reverse=True):
        total += counts[b]
        if total > most:
            break
        low = b
    return 1 << low


def _by_size(df: DataFrame) -> dict[int, int]:
    rows = df.groupBy(F.floor(F.log2(F.col("n").cast("double") + 0.5)).cast("int").alias("b")).count().collect()
    return {r["b"]: r["count"] for r in rows}                     # 64 rows at most


def train(cut: DataFrame, depth: int = 5, max_nodes: int = 2_000_000, max_known: int = 1_000_000, least: int = 1) -> dict:
    """The model of the training texts in ``cut`` (see ``blocks``): ``tree``, the part of
    the tree above depth ``GROUP``; ``answers`` (gram, n, p) of every byte string of all
    texts; ``known``, those of at least ``floor`` training counts.  A context seen
    fewer than ``least`` times gives no estimate of its own; weights come from all
    counts."""
    ship(cut.sparkSession)
    top = min(GROUP, depth)

    def count(batches):
        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting, held = [], 0
        def merged():
            every = np.concatenate([keys, *[k for k, _ in waiting]])
            order = np.argsort(every, kind="stable")
            return _sums(every[order], np.concatenate([sums, *[c for _, c in waiting]])[order])
        for b in batches:
            for i in range(b.num_rows):
                held_, words, codes, tokens = (_opened(c[i]) for c in b.columns)
                mask = ~held_.to_numpy(zero_copy_only=False).astype(bool)
                for g, text in _pieces(words, codes.to_numpy(), tokens.to_numpy(), depth):
                    learned = mask[text]
                    for part, times in ((g[learned], 1), (g[~learned], 0)):
                        k, c = np.unique(part, return_counts=True)
                        waiting.append((k, c * times))
                        held += len(k)
                    if held > max(500_000, len(keys) // 2):
                        keys, sums = merged()
                        waiting, held = [], 0
        keys, sums = merged()
        _give_back()
        for s in range(0, len(keys), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(keys[s:s + (1 << 18)].view(np.int64)), pa.array(sums[s:s + (1 << 18)])], ["gram", "n"])

    grams = (cut.select("held", "words", "codes", "tokens").mapInArrow(count, "gram long, n long")
             .groupBy("gram").agg(F.sum("n").alias("n")))
    lead = F.shiftrightunsigned("gram", 8 * (depth - top) + 8)
    bits = [f"b{j}" for j in range(8)]

    def rows(kind, key, n=None, pw=None, p=None):
        for s in range(0, len(key), 1 << 18):
            cut_ = slice(s, s + (1 << 18))
            size = len(key[cut_])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, kind, np.int32)), pa.array(key[cut_].view(np.int64)),
                 pa.nulls(size, pa.int64()) if n is None else pa.array(n[cut_]),
                 pa.nulls(size, pa.float64()) if pw is None else pa.array(pw[cut_]),
                 *[pa.nulls(size, pa.float32()) if p is None else pa.array(x[cut_].astype(np.float32)) for x in p or [None] * 8]],
                ["kind", "key", "n", "pw", *bits])

    def grow(batches):
        got = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        gram, n = (np.concatenate(x) for x in zip(*got))
        del got
        order = np.argsort(gram)
        gram, n = gram[order], n[order]
        # A gram has up to eight nodes a level.
        begins = np.append(_starts(gram >> np.uint64(8 * (depth - top) + 8))[0], len(gram))
        size, start = max(1, max_nodes // 8), 0
        while start < len(gram):
            stop = begins[max(np.searchsorted(begins, start + size, "right") - 1, np.searchsorted(begins, start, "right"))]
            g, c = gram[start:stop], n[start:stop]
            p, (key, pw) = subtrees(g, c, depth, top, least)
            yield from rows(0, g, n=c, p=list(p))
            for kind, whole, x in ((1, ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(255)), pw),
                                   (2, ((g >> np.uint64(8 * (depth - top + 1) + 8)) << np.uint64(8)) | (g & np.uint64(255)), c)):
                order = np.argsort(whole, kind="stable")
                whole, x = _sums(whole[order], x[order])
                yield from rows(kind, whole, **{"pw" if kind == 1 else "n": x})
            start = stop

    grown = written(grams.repartition(lead).select("gram", "n")
                    .mapInArrow(grow, "kind int, key long, n long, pw double, " + ", ".join(f"{b} float" for b in bits)), "lm-grown")
    # The top of the tree: at most 256^GROUP contexts, whatever the corpus.
    up = grown.where("kind = 1").groupBy("key").agg(F.sum("pw").alias("pw")).orderBy("key").toPandas()
    heads = grown.where("kind = 2").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0").orderBy("key").toPandas()
    # In double: next to 1, single precision rounds a rare bit's probability, or what is left for deeper contexts, to 0.
    tree = [(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))] * (depth + 1)
    whole = levels(heads["key"].to_numpy(np.uint64), heads["n"].to_numpy(np.int64), top - 1, 0,
                   (up["key"].to_numpy(np.uint64), up["pw"].to_numpy(np.float64)))
    for d, t in whole:
        seen = (t["n"] >= least) | (d == 0)
        tree[d] = (t["key"][seen], t["one"][seen], t["own"][seen])
    shared = cut.sparkSession.sparkContext.broadcast(tree)

    def answer(batches):
        for b in batches:
            if not b.num_rows:
                continue
            # A mixture is linear in what the deeper contexts say: three values a bit serve all grams of a head.
            g = b.column(0).to_numpy().view(np.uint64)
            part = ((g >> np.uint64(8 * (depth - top + 1) + 8)) << np.uint64(8)) | (g & np.uint64(255))
            head, of = np.unique(part, return_inverse=True)
            out = np.zeros(len(g))
            for j, (low, high, alone) in enumerate(zip(_bits(head, shared.value, top - 1, 0.0, True), _bits(head, shared.value, top - 1, 1.0, True),
                                                       _bits(head, shared.value, top - 1))):
                deep = b.column(2 + j).to_numpy().astype(np.float64)
                out += np.log10(np.where(np.isnan(deep), alone[of], low[of] + (high - low)[of] * deep))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out.astype(np.float32))], ["gram", "n", "p"])

    every = grown.where("kind = 0")
    floor = _histogram_floor(_by_size(every.where("n > 0")), max_known)
    found = lambda rows: rows.select(F.col("key").alias("gram"), "n", *bits).mapInArrow(answer, "gram long, n long, p float")
    table = found(every.where(F.col("n") >= floor)).select("gram", "p").toArrow()
    return {"depth": depth, "tree": shared, "answers": found(every.where(F.col("n") < floor)),
            "known": _hashed(table.column("gram").to_numpy().view(np.uint64), table.column("p").to_numpy())}


# --- scoring ----------------------------------------------------------------------

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashed(keys: np.ndarray, values: np.ndarray) -> dict:
    """An open-addressing table at most half full, filled round by round."""
    bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
    slots, held = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.float32)
    at = ((keys * _MIX) >> np.uint64(64 - bits)).astype(np.int64)
    rest = np.arange(len(keys))
    while len(rest):
        free = slots[at[rest]] == _EMPTY
        _, first = np.unique(at[rest[free]], return_index=True)
        placed = rest[free][first]
        slots[at[placed]], held[at[placed]] = keys[placed], values[placed]
        rest = rest[slots[at[rest]] != keys[rest]]
        at[rest] = (at[rest] + 1) & ((1 << bits) - 1)
    return {"slots": slots, "values": held, "bits": bits}


def _lookup(table: dict, keys: np.ndarray):
    """(values, found)."""
    bits, slots = table["bits"], table["slots"]
    at = ((keys * _MIX) >> np.uint64(64 - bits)).astype(np.int64)
    seen = slots[at]
    found = seen == keys
    out = table["values"][at].astype(np.float64)
    rest = np.nonzero(~found & (seen != _EMPTY))[0]
    while len(rest):
        at[rest] = (at[rest] + 1) & ((1 << bits) - 1)
        seen = slots[at[rest]]
        hit = seen == keys[rest]
        found[rest[hit]], out[rest[hit]] = True, table["values"][at[rest[hit]]]
        rest = rest[~hit & (seen != _EMPTY)]
    return out, found


def _asked(words, codes, tokens, known: dict, depth: int) -> np.ndarray:
    """The distinct grams of a block that are not in ``known``, sorted."""
    rare, waiting, held = np.zeros(0, np.uint64), [], 0
    for g, _ in _pieces(words, codes, tokens, depth):
        waiting.append(np.unique(g[~_lookup(known, g)[1]]))
        held += len(waiting[-1])
        if held > max(500_000, len(rare)):
            rare, waiting, held = np.unique(np.concatenate([rare, *waiting])), [], 0
    return np.unique(np.concatenate([rare, *waiting]))


def _text_scores(words, codes, tokens, known: dict, rare: np.ndarray, values: np.ndarray, depth: int) -> np.ndarray:
    """``rare`` (sorted) and ``values``: the block's grams outside ``known``."""
    out = np.zeros(len(tokens))
    for g, text in _pieces(words, codes, tokens, depth):
        p, found = _lookup(known, g)
        if not found.all():
            p[~found] = values[np.searchsorted(rare, g[~found])]
        out += np.bincount(text, weights=p, minlength=len(tokens))
    return out


def _answered(cut: DataFrame, model: dict, known, depth: int) -> DataFrame:
    """(block, gram, p) of the byte strings of every block outside ``known``, ``_packed``."""
    def ask(batches):
        for b in batches:
            for i in range(b.num_rows):
                words, codes, tokens = (_opened(b.column(c)[i]) for c in (1, 2, 3))
                rare = _asked(words, codes.to_numpy(), tokens.to_numpy(), known.value, depth)
                _give_back()
                for s in range(0, len(rare), 1 << 18):
                    g = rare[s:s + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.full(len(g), b.column(0)[i].as_py()))], ["gram", "block"])

    def gather(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("gram").to_numpy().view(np.uint64))
        return pa.Table.from_arrays([rows.column("block")[:1], *[pa.array([_packed(rows.column(c).to_numpy()[order])], pa.binary()) for c in ("gram", "p")]],
                                    names=["block", "gram", "p"])

    asked = cut.select("block", "words", "codes", "tokens").mapInArrow(ask, "gram long, block long")
    return (asked.join(model["answers"].select("gram", "p"), "gram").select("block", "gram", "p")
            .groupBy("block").applyInArrow(gather, "block long, gram binary, p binary"))


def _entries(batches):
    """(block, pos, word, train) of every word of the blocks."""
    for b in batches:
        for i in range(b.num_rows):
            words, train = (_opened(b.column(c)[i]) for c in (1, 2))
            for s in range(0, len(words), 1 << 16):
                w, n = words[s:s + (1 << 16)], train[s:s + (1 << 16)].cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), b.column(0)[i].as_py())), pa.array(np.arange(s, s + len(w), dtype=np.int32)), w, n],
                                                 ["block", "pos", "word", "train"])


def _told(rows: pa.Table) -> pa.Table:
    """A block's words' counts in order, ``_packed``, and how many words seen in training have
    their first block here."""
    pos, c, new = (rows.column(k).to_numpy() for k in ("pos", "c", "new"))
    counts = np.empty(len(c), np.int64)
    counts[pos] = c
    return pa.Table.from_arrays([rows.column("block")[:1], pa.array([_packed(counts)], pa.binary()), pa.array([int((new & (c > 0)).sum())])],
                                names=["block", "c", "new"])


def score(docs: DataFrame, held_out, depth: int = 5, **bounds) -> DataFrame:
    """(row, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) of
    every text; ``row`` holds the other columns.  Learns from rows where
    ``held_out`` is false."""
    cut = blocks(docs, held_out)
    model = train(cut, depth, **bounds)
    by_word = Window.partitionBy("word")
    told = (cut.select("block", "words", "train").mapInArrow(_entries, "block long, pos int, word binary, train long")
            .select("block", "pos", F.sum("train").over(by_word).alias("c"),
                    (F.row_number().over(by_word.orderBy("block")) == 1).alias("new")))
    told = written(told.groupBy("block").applyInArrow(_told, "block long, c binary, new long"), "lm-counts")
    v = told.agg(F.sum("new")).first()[0] or 0
    n = cut.agg(F.sum("learned")).first()[0] or 0
    known = cut.sparkSession.sparkContext.broadcast(model["known"])
    told = told.select("block", "c").join(written(_answered(cut, model, known, depth), "lm-answers"), "block", "left")
    joined = cut.select("block", "row", "held", "words", "codes", "tokens").join(told, "block").drop("block")
    kind = cut.schema["row"].dataType.elementType

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.column(0)[i].values
                held, words, codes, tokens, c = (_opened(b.column(k)[i]) for k in range(1, 6))
                rare, values = (_opened(x).to_numpy() if (x := b.column(k)[i]).is_valid else np.zeros(0) for k in (6, 7))
                codes, tokens, c = codes.to_numpy(), tokens.to_numpy(), c.to_numpy()
                first = np.concatenate(([0], np.cumsum(tokens)[:-1]))
                base = np.add.reduceat(np.log10(c + 1.0)[codes], first) - tokens * np.log10(n + v + 1.0)
                size = np.array(pa.compute.binary_length(words).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [row, held, pa.array(tokens.astype(np.int64)), pa.array(np.add.reduceat((c > 0)[codes].astype(np.int64), first)),
                     pa.array(np.full(len(tokens), n, np.int64)), pa.array(base),
                     pa.array(_text_scores(words, codes, tokens, known.value, rare.astype(np.int64).view(np.uint64), values, depth)),
                     pa.array(np.add.reduceat(size[codes].astype(np.int64), first))],
                    ["row", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])
                _give_back()

    return joined.mapInArrow(run, StructType([StructField("row", kind), *StructType.fromDDL(
        "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long").fields]))
