"""Hard negatives, prefix trie and substring dedup against brute force, with nulls
in any column, empty and very long texts, ties, repeated rows, empty tables and
clashing columns."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from migrakit.llm import hard_negatives, prefix_trie, substring_dedup

# --- hard negatives ---------------------------------------------------------


def _vectors():
    rnd, rows = random.Random(5), []
    for i in range(700):
        rows.append((i, rnd.randrange(3), [rnd.randrange(-40, 60) for _ in range(6)]))
    copy = [9, 9, 9, -3, 0, 5]
    rows += [(1000 + i, i % 3, copy) for i in range(900)]                      # copies: ties by id
    rows += [(1000, 1, copy), (1000, 1, copy), (100, 1, [1, 2, 3, 4, 5, 6])]   # repeated rows and ids
    rows += [(3000 + i, 1, [1 << 40, i]) for i in range(4)] + [(3100 + i, i % 2, []) for i in range(3)]
    rows += [(None, 1, copy), (4000, None, copy), (4001, 1, None), (4002, 1, [1, None, 2, 3, 4, 5]), (4100, 1, [1 << 62, 1])]
    return rows


def _mined(rows, positives, negatives, window):
    def usable(r):
        if r[0] is None or r[1] is None or r[2] is None or any(x is None for x in r[2]):
            return False
        most = int((9.2e18 / max(len(r[2]), 1)) ** 0.5)
        return all(-most <= x <= most for x in r[2])
    rows = [r for r in rows if usable(r)]
    out = []
    for a, anchor in enumerate(rows):
        if anchor[0] % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(anchor[2], r[2])), r[0], r[1] == anchor[1]) for i, r in enumerate(rows)
                        if i != a and len(r[2]) == len(anchor[2]))
        for p in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and window[0] * -p[0] <= 100 * -s[0] <= window[1] * -p[0]][:negatives]
            out += [(anchor[0], p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(fit)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SAMPLE", 64)
    rows = _vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, vector array<long>, chunk string, anchor int").repartition(5)
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, positives=4, negatives=7, window=(30, 90))
    assert sorted(tuple(r) for r in got.collect()) == _mined(rows, 4, 7, (30, 90))


def test_hard_negatives_without_rows_or_anchors(spark):
    df = spark.createDataFrame([], "vec_id long, label int, vector array<long>")
    assert hard_negatives.mine(df, F.col("vec_id") % 100 == 0).count() == 0
    df = spark.createDataFrame([(1, 1, [1, 2]), (2, 1, [1, 2])], df.schema)
    assert hard_negatives.mine(df, F.col("vec_id") % 100 == 0).count() == 0


def test_quantised_components(spark):
    df = spark.createDataFrame([([0.5, -0.001, None, float("nan"), float("inf")],)], "e array<float>")
    assert df.select(hard_negatives.quantised(F.col("e"))).first()[0] == [128, -1, None, None, None]


def test_boxes_bound_every_score():
    import numpy as np
    rnd = np.random.default_rng(1)
    v, q = rnd.integers(-50, 50, (300, 5)), rnd.integers(-50, 50, (20, 5))
    least, most = hard_negatives.bounds(q, v.min(axis=0)[None], v.max(axis=0)[None])
    s = q @ v.T
    assert (least <= s).all() and (s <= most).all()


# --- prefix trie -------------------------------------------------------------


def _trie(rows, family=100, heads=6):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(own.get(c - c % family, [])[:h] + ts[h:])
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[:len(path)] == path]
        leaf = lambda p: not any(len(x) == len(p) + 1 and x[:-1] == p for x in nodes)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                    sum(len(x) == len(path) + 1 and x[:-1] == path for x in nodes), sum(map(leaf, under)),
                    sum((len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) for p in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _conversations():
    rnd, rows = random.Random(3), []
    for c in range(0, 330, 3):
        rows += [(c, t, rnd.choice(["user", None, "é"]), rnd.choice(["hello", "", None, "long 😀 text"])) for t in range(rnd.randrange(1, 5))]
    rows += [(500 + c, 0, "user", "shared") for c in range(40)]
    rows += [(7, t % 60, "r", f"t{t % 2}") for t in range(120)] + [(8, None, "r", "x"), (8, None, "r", "x"), (8, 1, None, None)]
    rows += [(None, 1, "user", "nobody"), (900, None, None, None), (10**12, 0, "user", "shared")]
    return rows


@pytest.mark.parametrize("block", [4, 4096])
def test_prefix_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "GROUP", block)
    rows = _conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, node int").repartition(3)
    got = prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(prefix_trie.turns(df)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == _trie(rows)


def test_prefix_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(prefix_trie.turns(df))).count() == 0


# --- substring dedup ----------------------------------------------------------


def _without_repeats(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i:i + window]), []).append((d, i))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    return [(len(w), len(g), " ".join(x for j, x in enumerate(w) if j not in g)) for w, g in zip(words, gone)]


def _texts():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 4)))
    fresh = lambda n: [word() + str(rnd.randrange(10**6)) for _ in range(n)]          # noqa: E731
    shared = [fresh(n) for n in (9, 10, 11, 40)]
    texts = [None, "", " \t\n", "a b c", " ".join(["a"] * 300), "\x85 \xa0x\n\x1cy"]
    for i in range(60):
        parts = fresh(rnd.randrange(0, 30))
        for _ in range(rnd.randrange(0, 3)):
            parts += rnd.choice(shared) + fresh(rnd.randrange(0, 5))
        texts.append(rnd.choice([" ", "\n", "  "]).join(parts))
    texts += [texts[10]] * 3 + [" ".join(fresh(30_000))] + [" ".join(shared[1])] * 2
    low = [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(5, 200))) for _ in range(15)]     # phrases in many contexts
    return texts + low + [" ".join(["x", "y", "z"] * 50)]


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 200, "piece_bytes": 150, "part_bytes": 400}])
def test_substring_dedup_equals_brute_force(spark, sizes):
    texts = _texts()
    df = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, owner string, u1 int, kept string")
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.remove_repeats(df.repartition(4), window=10, phrase=4, **sizes)
           .select("row.doc_id", "n_words", "n_removed", "text").collect()}
    want = dict(enumerate(_without_repeats(texts, 10)))
    assert got == want
    assert any(n for _, n, _ in want.values())


def test_substring_dedup_digests_and_nothing(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string")
    got = substring_dedup.remove_repeats(df, digest=True)
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((tuple(r) for r in got.select("n_words", "n_removed", "kept_sha256").collect())) == [(0, 0, empty), (40, 40, empty), (40, 40, empty)]
    assert substring_dedup.remove_repeats(df.where("false")).count() == 0
