"""Substring dedup: repeated passages of words, found by automata.

A window is ``window`` consecutive words of one text.  A window recurs if its
words start at two places or more, in one text or in several; every word inside
a recurring window is removed.

1. Every window is named after one of its phrases (``phrase`` consecutive
   words: the leftmost with the smallest hash), so equal windows have equal
   phrases and about one place in fourteen is shuffled.  Windows whose phrase
   is found at one place only cannot recur and go no further.
2. The other windows lie in segments, runs of windows of one text whose phrases
   first occur in the same text (the phrase's owner).  Equal windows so meet
   under one owner, whatever else their texts hold.
3. Windows of the segments are counted by a 128-bit hash; recurring ones are
   confirmed, and each is kept at one place: runs of those are the passages.
4. Passages are dealt over shards by owner; a shard's passages, in pieces of at
   most ``piece_bytes``, are compiled into an Aho-Corasick automaton over words,
   and the segments of all texts stream through it.  The windows around a hit
   are looked up among the passages' windows and compared word for word.

A text that holds no phrase found elsewhere holds no occurrence, so streaming
the segments is streaming all documents.  Equal texts are worked on once, with
their number.  A shard with many segments is dealt over several tasks, each with
its own copy of the automaton; a shard with many passages over several
automata.  A task holds one piece and a batch of segments.  The two hashes that
decide, 128 bits of a text and of a window, are not compared further; word
hashes are.

Defined results: a null text has no words; a text shorter than a window keeps
all its words; equal rows are told apart, so a text of ``window`` words that two
rows hold is removed from both; an empty table gives no rows; the caller's
columns travel in a struct.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import packed_columns, ship, whole_text, written

#: Bytes of text (at least one text) hashed at once in a task.
_BLOCK = 1 << 20

_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: A random number for every byte, per hash.
_BYTES = np.random.default_rng(42).integers(0, 1 << 64, (2, 256), np.uint64)


def _schema(**fields) -> StructType:
    return StructType([StructField(k, t) for k, t in fields.items()])


_L, _I = LongType(), IntegerType()
_PLACE = _schema(phrase=_L, u1=_L, u2=_L, first=_I, last=_I)
_SEGMENT = _schema(owner=_L, u1=_L, u2=_L, first=_I, text=BinaryType(), copies=_L)
_WINDOW = _schema(h1=_L, h2=_L, sid=_L, copies=_L)
_PASSAGE = _schema(owner=_L, text=BinaryType())
_SPAN = _schema(u1=_L, u2=_L, begin=_I, end=_I)
_FIXED = _schema(u1=_L, u2=_L, n_removed=_L, kept=StringType())


# --- hashing, vectorised over many texts -----------------------------------

_powers_of: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    p = _powers_of.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, _BLOCK) + 1, base, np.uint64)
        p[0] = 1
        p = _powers_of[base] = np.cumprod(p, dtype=np.uint64)
    return p[:n]


def _polynomial(x: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of x[begin:end] for many stretches: the sum of x[begin + i] * base**i,
    from one running sum, mixed."""
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _powers(base, len(x)), out=total[1:])
    h = (total[end] - total[begin]) * _powers(pow(base, -1, 1 << 64), len(x) + 1)[begin] + (end - begin).astype(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts (an Arrow binary array) laid end to end: byte
    offsets, number per text, hashes."""

    def __init__(self, texts: pa.Array):
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        word = ~_SPACE[self.data]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        full = off[1:] > off[:-1]
        opens[off[:-1][full]] = word[off[:-1][full]]                # a text's end ends a word
        closes[off[1:][full] - 1] = word[off[1:][full] - 1]
        self.begin, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.zero = np.searchsorted(self.begin, off)                # every text's first word
        self.counts = np.diff(self.zero)
        self._lanes: dict[int, np.ndarray] = {}

    def lane(self, i: int) -> np.ndarray:
        """64 bits of every word."""
        if i not in self._lanes:
            self._lanes[i] = _polynomial(_BYTES[i][self.data], self.begin, self.end, _BASES[i])
        return self._lanes[i]

    def starts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places where ``k`` words of one text start, and their texts."""
        n = np.maximum(self.counts - k + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        return np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + self.zero[:-1][text], text

    def hashes(self, i: int, at: np.ndarray, k: int) -> np.ndarray:
        """64 bits of the ``k`` words from each place on."""
        return _polynomial(self.lane(i), at, at + k, _BASES[i])


def _blocks(batch: pa.RecordBatch, text: str = "text"):
    """(first row, words) for stretches of a batch of bounded size."""
    col = batch.column(text)
    size = np.cumsum(np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1])) if len(col) else []
    row = 0
    while row < len(col):
        past = int(np.searchsorted(size, (size[row - 1] if row else 0) + _BLOCK))
        stop = max(row + 1, min(past, len(col)))
        yield row, Words(col.slice(row, stop - row))
        row = stop


def _batch(schema: StructType, *cols) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema
    s = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, s)], names=s.names)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Where the least of every ``width`` consecutive numbers is: by their upper 32
    bits, then leftmost."""
    m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    k = 1
    while 2 * k <= width:
        m, k = np.minimum(m[:-k], m[k:]), 2 * k
    if k < width:
        m = np.minimum(m[:k - width], m[width - k:])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _phrases(window: int, phrase: int):
    """Every run of windows that share their phrase's place."""
    width = window - phrase + 1

    def run(batches):
        for b in batches:
            u1, u2 = (np.asarray(b.column(c)) for c in ("u1", "u2"))
            for row, w in _blocks(b):
                at, text = w.starts(window)
                if not len(at):
                    continue
                h = w.hashes(0, np.arange(len(w.begin) - phrase + 1), phrase)
                place = _least(h, width)[at]
                cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
                stop = np.r_[cut[1:], len(at)] - 1
                zero, rows = w.zero[text[cut]], row + text[cut]
                yield _batch(_PLACE, h[place[cut]].view(np.int64), u1[rows], u2[rows], (at[cut] - zero).astype(np.int32),
                             (at[stop] - zero).astype(np.int32))
    return run


def _segments(window: int):
    """The stretches of a text's words under one owner each."""
    def run(batches):
        for b in batches:
            places, out = b.column("places"), []
            flat = places.flatten()
            first, last, owner = (np.asarray(flat.field(c)) for c in ("first", "last", "owner"))
            row = np.repeat(np.arange(len(places)), np.diff(np.asarray(places.offsets)))
            order = np.lexsort((first, row))
            first, last, owner, row = first[order], last[order], owner[order], row[order]
            cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | (first[1:] > last[:-1] + 1)][:len(row)])
            stop = np.r_[cut[1:], len(row)] - 1
            at, words = -1, []
            texts, u1, u2, copies = (b.column(c) for c in ("text", "u1", "u2", "copies"))
            for r, x, y, o in zip(row[cut].tolist(), first[cut].tolist(), last[stop].tolist(), owner[cut].tolist()):
                if r != at:
                    at, words = r, texts[r].as_py().split()
                out.append((o, u1[r].as_py(), u2[r].as_py(), x, b" ".join(words[x:y + window]), copies[r].as_py()))
            if out:
                yield _batch(_SEGMENT, *zip(*out))
    return run


def _windows(window: int):
    def run(batches):
        for b in batches:
            sid, copies = (np.asarray(b.column(c)) for c in ("sid", "copies"))
            for row, w in _blocks(b):
                at, text = w.starts(window)
                if len(at):
                    yield _batch(_WINDOW, w.hashes(0, at, window).view(np.int64), w.hashes(1, at, window).view(np.int64),
                                 sid[row + text], copies[row + text])
    return run


def _passages(window: int):
    """Of every segment, the runs of windows that are kept there."""
    def run(batches):
        for b in batches:
            owner, out = np.asarray(b.column("owner")), []
            edge = np.asarray(b.column("h1").offsets)
            kept = [np.asarray(b.column(c).flatten()).view(np.uint64) for c in ("h1", "h2")]
            for row, w in _blocks(b):
                at, text = w.starts(window)
                if not len(at):
                    continue
                # A segment's number mixed into the hashes: kept windows count in their own segment only.
                salt = _polynomial(np.arange(len(w.counts), dtype=np.uint64), np.arange(len(w.counts)), np.arange(len(w.counts)) + 1, _BASES[0])
                here = slice(edge[row] - edge[0], edge[row + len(w.counts)] - edge[0])
                own = np.repeat(salt, np.diff(edge[row:row + len(w.counts) + 1]))
                mark = np.isin(w.hashes(0, at, window) ^ salt[text], kept[0][here] ^ own) \
                    & np.isin(w.hashes(1, at, window) ^ salt[text], kept[1][here] ^ own)
                at, text = at[mark], text[mark]
                if not len(at):
                    continue
                cut = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)])
                stop = np.r_[cut[1:], len(at)] - 1
                data = w.data.tobytes()
                out += [(int(owner[row + t]), data[x:y]) for t, x, y in
                        zip(text[cut], w.begin[at[cut]], w.end[at[stop] + window - 1])]
            if out:
                yield _batch(_PASSAGE, *zip(*out))
    return run


# --- automata ---------------------------------------------------------------

def _symbols(lane: np.ndarray) -> str:
    """Three symbols of six bits per word, each place with an alphabet of its own:
    a small fan-out, and matches that begin at a word."""
    bits = [((lane >> np.uint64(46 + 6 * j)) & np.uint64(63)).astype(np.uint8) + np.uint8(33 + 64 * j) for j in range(3)]
    return np.stack(bits, axis=1).tobytes().decode("latin-1")


class Passages:
    """Some passages, the automaton that finds their phrases, and their windows in
    the order of their hashes.  Every window of a passage holds one of the phrases
    taken at each ``window - phrase + 1`` words.  However many passages hold a
    phrase, a hit costs the windows around it."""

    def __init__(self, texts: pa.Array, window: int, phrase: int):
        import ahocorasick

        self.window, self.phrase, self.words = window, phrase, Words(texts)
        self.data = self.words.data.tobytes()
        at, _ = self.words.starts(window)
        h = self.words.hashes(0, at, window)
        order = np.argsort(h, kind="stable")
        self.hashes, self.at = h[order], at[order]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        symbols = _symbols(self.words.lane(0))
        for begin, end in zip(self.words.zero[:-1].tolist(), self.words.zero[1:].tolist()):
            for o in range(begin, end - phrase + 1, window - phrase + 1):
                self.automaton.add_word(symbols[3 * o:3 * (o + phrase)], 0)
        self.automaton.make_automaton()

    def _equal(self, w: Words, data: bytes, i: int, j: int, n: int) -> list[tuple[int, int]]:
        """Stretches of a window or more in which word i + x equals the passages' word
        j + x.  Words are one space apart, so their bytes tell."""
        p = self.words
        if data[w.begin[i]:w.end[i + n - 1]] == self.data[p.begin[j]:p.end[j + n - 1]]:
            return [(i, i + n)]
        same = np.array([data[w.begin[i + x]:w.end[i + x]] == self.data[p.begin[j + x]:p.end[j + x]] for x in range(n)])
        edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))      # equal hashes decide nothing
        return [(i + int(a), i + int(b)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= self.window]

    def spans(self, w: Words) -> list[tuple[int, int, int]]:
        """(text, begin, end) of the words of some texts that occurrences cover."""
        at, text = w.starts(self.window)
        if not len(at) or not len(self.at):
            return []
        ends = np.array([e for e, _ in self.automaton.iter(_symbols(w.lane(0)))], np.int64) // 3
        n = len(w.begin)
        near = np.zeros(n + 1, np.int64)                          # windows that hold a hit
        np.add.at(near, np.maximum(ends - self.window + 1, 0), 1)
        np.add.at(near, ends - self.phrase + 2, -1)
        close = (np.cumsum(near[:-1]) > 0)[at]
        at, text = at[close], text[close]
        h = w.hashes(0, at, self.window)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        found = self.hashes[place] == h
        here, there, text = at[found], self.at[place[found]], text[found]
        if not len(here):
            return []
        cut = np.flatnonzero(np.r_[True, (np.diff(here) != 1) | (np.diff(there) != 1) | (np.diff(text) != 0)])
        stop = np.r_[cut[1:], len(here)] - 1
        data, zero = w.data.tobytes(), w.zero
        return [(int(text[a]), x - int(zero[text[a]]), y - int(zero[text[a]])) for a, b in zip(cut.tolist(), stop.tolist())
                for x, y in self._equal(w, data, int(here[a]), int(there[a]), int(here[b] - here[a]) + self.window)]


def _stream(window: int, phrase: int):
    """Rows sorted by shard, piece and part, passages before segments: compiles
    each piece and streams its segments."""
    def run(batches):
        key, texts, automaton = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            cols = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("shard", "piece", "part", "kind")])
            edge = np.flatnonzero(np.r_[True, (cols[:, 1:] != cols[:, :-1]).any(axis=0)])
            for x, y in zip(edge, np.r_[edge[1:], b.num_rows]):
                here, rows = tuple(cols[:3, x]), b.slice(x, y - x)
                if here != key:
                    key, texts, automaton = here, [], None
                if cols[3, x] == 0:
                    texts.append(rows.column("text"))
                    continue
                if not texts:
                    continue
                automaton = automaton or Passages(pa.concat_arrays(texts), window, phrase)
                u1, u2, first = (np.asarray(rows.column(c)) for c in ("u1", "u2", "first"))
                for row, w in _blocks(rows):
                    found = automaton.spans(w)
                    if found:
                        t, p, q = (np.array(c) for c in zip(*found))
                        yield _batch(_SPAN, u1[row + t], u2[row + t], (first[row + t] + p).astype(np.int32), (first[row + t] + q).astype(np.int32))
    return run


def _fix(batches):
    """A text without the words inside its spans."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            words = r["text"].split()
            gone = np.zeros(len(words) + 1, np.int64)
            for s in r["spans"]:
                gone[s["begin"]] += 1
                gone[s["end"]] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            out.append((r["u1"], r["u2"], int(gone.sum()), b" ".join([w for w, g in zip(words, gone) if not g]).decode()))
        if out:
            yield _batch(_FIXED, *zip(*out))


def _plain(digest: bool):
    """Number of words, and all words joined by one space or the digest of that."""
    def run(batches):
        for b in batches:
            n, out = [], []
            for t in b.column("text"):
                words = t.as_py().split()
                n.append(len(words))
                whole = b" ".join(words)
                out.append(sha256(whole).hexdigest() if digest else whole.decode())
            cols = {"n_words": pa.array(n, pa.int64()), "plain": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row", "u1", "u2")], *cols.values()], names=["row", "u1", "u2", *cols])
    return run


# --- the operator -------------------------------------------------------------

def _names() -> list[Column]:
    """128 bits that name a text."""
    t = whole_text("text")
    return [F.xxhash64(t).alias("u1"), F.xxhash64(F.lit("second"), t).alias("u2")]


def repeated(docs: DataFrame, window: int = 35, phrase: int = 8, shard_bytes: int = 4 << 20,
             piece_bytes: int = 8 << 20, part_bytes: int = 16 << 20) -> DataFrame:
    """(u1, u2, n_removed, kept) of every distinct text that holds a recurring
    window; ``kept`` is the words that stay, joined by one space."""
    ship(docs.sparkSession)
    texts = docs.select(F.encode(whole_text("text"), "UTF-8").alias("text"), *_names())
    places = written(texts.mapInArrow(_phrases(window, phrase), _PLACE), "substring-places")
    # Written, so that a phrase in many texts can be split in the join below.
    owners = written(places.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min("u1").alias("owner"))
                     .where("n > 1").select("phrase", "owner"), "substring-owners")
    again = (places.join(owners, "phrase").groupBy("u1", "u2")
             .agg(F.collect_set(F.struct("first", "last", "owner")).alias("places")))     # at most the text's words
    distinct = texts.groupBy("u1", "u2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    held = written(distinct.join(again, ["u1", "u2"]).select("u1", "u2", "text", "places", "copies"), "substring-texts")
    segments = written(held.mapInArrow(_segments(window), _SEGMENT).withColumn("sid", F.monotonically_increasing_id()),
                       "substring-segments")
    kept = (segments.select("sid", "copies", "text").mapInArrow(_windows(window), _WINDOW).groupBy("h1", "h2")
            .agg(F.sum("copies").alias("n"), F.min("sid").alias("sid")).where("n > 1")
            .groupBy("sid").agg(F.collect_list("h1").alias("h1"), F.collect_list("h2").alias("h2")))     # at most the segment's windows
    passages = written(segments.select("sid", "owner", "text").join(kept, "sid").mapInArrow(_passages(window), _PASSAGE),
                       "substring-passages")
    total = passages.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards)).alias("shard")
    nil = F.lit(None)
    both = (passages.select(shard, F.lit(0).alias("kind"), nil.cast("long").alias("u1"), nil.cast("long").alias("u2"),
                            F.lit(0).alias("first"), "text")
            .unionByName(segments.select(shard, F.lit(1).alias("kind"), "u1", "u2", "first", "text")))
    size = F.length("text").cast("long")
    sizes = (both.groupBy("shard").agg(F.sum(F.when(F.col("kind") == 0, size)).alias("p"),
                                       F.sum(F.when(F.col("kind") == 1, size)).alias("s"))
             .where("p > 0").select("shard", F.ceil(F.col("p") / piece_bytes).cast("int").alias("pieces"),
                                    F.ceil(F.col("s") / part_bytes).cast("int").alias("parts")))
    pick = lambda n: F.pmod(F.xxhash64("u1", "first", "text"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))                   # noqa: E731
    both = both.join(sizes, "shard")
    lo = both.where("kind = 0").withColumn("piece", pick("pieces")).withColumn("part", every("parts"))
    hi = both.where("kind = 1").withColumn("part", pick("parts")).withColumn("piece", every("pieces"))
    key = ["shard", "piece", "part"]
    work = (lo.unionByName(hi).select(*key, "kind", "u1", "u2", "first", "text").repartition(*key)
            .sortWithinPartitions(*key, "kind"))
    spans = (work.mapInArrow(_stream(window, phrase), _SPAN).groupBy("u1", "u2")
             .agg(F.collect_set(F.struct("begin", "end")).alias("spans")))                # at most the text's words
    return held.select("u1", "u2", "text").join(spans, ["u1", "u2"]).mapInArrow(_fix, _FIXED)


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, digest: bool = False, **how) -> DataFrame:
    """(row, n_words, n_removed, text) of every row: ``text`` is the words that
    stay, joined by one space.  ``digest``: in place of the text its SHA-256 in
    ``kept_sha256``, so that the last join moves no text."""
    fixed = written(repeated(docs, **how), "substring-fixed")
    if digest:
        fixed = fixed.withColumn("kept", F.sha2(F.encode("kept", "UTF-8"), 256))
    rows = docs.select(packed_columns(docs, keep), F.encode(whole_text("text"), "UTF-8").alias("text"), *_names())
    schema = StructType([rows.schema["row"], *_schema(u1=_L, u2=_L, n_words=_L, plain=StringType()).fields])
    return (rows.mapInArrow(_plain(digest), schema).join(fixed, ["u1", "u2"], "left")
            .select("row", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                    F.coalesce("kept", "plain").alias("kept_sha256" if digest else "text")))
