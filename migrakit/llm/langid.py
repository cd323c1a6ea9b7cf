"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (drawn from the letter's code
point, so every executor draws the same).  An n-gram binds its letters'
vectors, each rotated by its place, by multiplication; a text bundles its
n-grams by addition; a language's prototype bundles the texts of that
language.  A text is given the language whose prototype has the largest
cosine with its vector.

Learning reads every labelled training row once and sums integer vectors per
task and language; the model is one vector per language (``dim`` numbers), which
is what the driver holds and tasks get.  N-grams are counted first and bound
once per distinct n-gram of a batch; batches hold about a million characters,
so memory does not depend on the table.

Letters are what Unicode calls alphabetic, lower-cased; a run of anything else
is one space, and a text begins and ends with a space.  Texts are read whole,
in pieces of ``PIECE`` characters (n-grams do not cross pieces).

Defined results: ``und`` with score 0 for a null text, a text without letters,
and every text if nothing was learned; equal cosines give the first language by
code point; a row without lang teaches nothing; equal rows get equal results;
an empty table gives no rows; the caller's columns are kept.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

PIECE = 1_000_000
UNKNOWN = "und"
#: More distinct lang values than this are not a language column (``learn(most_languages=...)``
#: allows more: the model holds 8 KB a language in the driver and in every task).
MAX_LANGUAGES = 4096


@lru_cache(1)
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(65536)
def _letter(code: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, code)).integers(0, 2, dim, np.int8) * 2 - 1


def _symbols(text: str) -> np.ndarray:
    """Lower-cased letters as code points, 0 for a run of anything else; a 0 at
    both ends.  Empty if there is no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    c = np.where(_alphabetic()[np.minimum(c, 0x10FFFF)], c, 0)
    if not c.any():
        return c[:0]
    c = np.concatenate(([0], c, [0]))
    return c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]


def bundle(texts: list[tuple[int, str]], slots: int, dim: int, n: int, seed: int) -> np.ndarray:
    """Sum of the n-gram vectors of the texts of every slot: (slot, text) pairs
    to an integer matrix (slots, dim)."""
    out = np.zeros((slots, dim), np.float64)
    parts = [(s, _symbols(t[i:i + PIECE])) for s, t in texts for i in range(0, len(t), PIECE)]
    parts = [(s, c) for s, c in parts if len(c) >= n]
    if not parts:
        return out
    symbols = np.concatenate([c for _, c in parts])
    lengths = np.array([len(c) for _, c in parts])
    letters, code = np.unique(symbols, return_inverse=True)
    k = len(letters)
    last = np.repeat(np.cumsum(lengths), lengths) - n        # an n-gram begins no later than this
    start = np.nonzero(np.arange(len(symbols)) <= last)[0]
    slot = np.repeat(np.array([s for s, _ in parts]), lengths)[start]
    _, slot = np.unique(slot, return_inverse=True)
    used = np.unique(np.array([s for s, _ in parts]))
    gram = np.zeros(len(start), np.int64)
    for i in range(n):
        gram = gram * k + code[start + i]
    key, count = np.unique(gram * len(used) + slot, return_counts=True)
    grams, column = np.unique(key // len(used), return_inverse=True)
    row = key % len(used)
    bound = np.stack([_letter(int(x), dim, seed) for x in letters])
    for at in range(0, len(grams), 8192):       # distinct n-grams in blocks: the matrices stay small
        block = grams[at:at + 8192]
        vectors, rest = np.ones((len(block), dim), np.int8), block.copy()
        for i in range(n):                      # the last letter first; each place rotates once more
            vectors *= np.roll(bound, i, axis=1)[rest % k]
            rest //= k
        inside = (column >= at) & (column < at + len(block))
        counts = np.zeros((len(used), len(block)), np.float32)
        counts[row[inside], column[inside] - at] = count[inside]
        out[used] += counts @ vectors.astype(np.float32)
    return out


def _chunks(texts):
    """Lists of (index, text) of about a million characters."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if group and size + len(t or "") > PIECE:
            yield group
            group, size = [], 0
        group.append((i, t or ""))
        size += len(t or "")
    if group:
        yield group


def learn(rows: DataFrame, dim: int = 1024, n: int = 3, seed: int = 20, most_languages: int = MAX_LANGUAGES) -> dict:
    """The model of (text, lang) rows; rows without either teach nothing.  More than
    ``most_languages`` distinct lang values raise ValueError."""
    ship(rows.sparkSession)
    labelled = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna()

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for chunk in _chunks(b.column(0).to_pylist()):
                names = sorted({langs[i] for i, _ in chunk})
                at = {x: j for j, x in enumerate(names)}
                v = bundle([(at[langs[i]], t) for i, t in chunk], len(names), dim, n, seed)
                for x in names:
                    sums[x] = sums.get(x, 0) + v[at[x]]
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([sums[x].astype(np.int64) for x in names], pa.list_(pa.int64()))], ["lang", "v"])

    partial = labelled.mapInArrow(run, "lang string, v array<bigint>")
    summed = (partial.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
              .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
              .select("lang", F.col("v.x").alias("v")).orderBy("lang").limit(most_languages + 1).collect())
    if len(summed) > most_languages:
        raise ValueError(f"more than {most_languages} distinct lang values")
    vectors = np.array([r["v"] for r in summed], np.float64).reshape(len(summed), dim)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    return {"langs": [r["lang"] for r in summed], "unit": unit, "dim": dim, "n": n, "seed": seed}


def predict(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model["langs"]:
        return langs, scores
    for chunk in _chunks(texts):
        v = bundle([(j, t) for j, (_, t) in enumerate(chunk)], len(chunk), model["dim"], model["n"], model["seed"])
        letters = np.array([any(map(str.isalpha, t)) for _, t in chunk])
        norm = np.linalg.norm(v, axis=1)
        cos = (v @ model["unit"].T) / np.maximum(norm, 1e-12)[:, None]
        best = cos.argmax(axis=1)
        for j, (i, _) in enumerate(chunk):
            if letters[j]:
                langs[i] = model["langs"][best[j]]
                scores[i] = min(1.0, max(0.0, float(cos[j, best[j]])))
    return langs, scores


def identify(docs: DataFrame, model: dict, name: str = "lang_id") -> DataFrame:
    """``docs`` with a column ``name``: struct of ``lang`` and ``score``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    def guess(text: pa.Array) -> pa.Array:
        langs, scores = predict(text.to_pylist(), shared.value)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], fields=list(kind))

    return docs.withColumn(name, guess.asNondeterministic()(F.col("text").cast("string")))


def held_out(doc_id, of: int = 5):
    """Rows kept from learning: crc32 of doc_id as text, modulo ``of``, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == 0
