"""Operators without a statement against brute force, inverses or held-out
accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from migrakit.llm import langid, lm_score, mixing, pii, queries, sharding, simhash, token_counts
from tests.conftest import SF_SMALL

TEXTS = ["the cat sat on the mat", "the cat sat on the hat", "a dog ate the cat", "", None, "zebra crossing", "the the the the"]


# --- 1: mixing ------------------------------------------------------------------------

def test_schedules_are_integrated_and_inverted(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    knots = spark.createDataFrame([("a", 0.0, 2.0), ("a", 0.5, 0.0), ("a", 1.0, 0.0), ("b", 0.0, 1.0), ("b", 1.0, 1.0)],
                                  "source string, t double, rate double")
    m = mixing.mix(docs, weights, knots)
    got = m.select("doc_id", "source", "size", "source_size", "target", "copies", "positions").collect()
    size = Counter()
    for r in got:
        size[r["source"]] += r["size"]
    total = sum(size.values())
    for s, share in (("a", 0.75), ("b", 0.25)):
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(share * total)
        taken = sum(r["size"] * r["copies"] for r in mine)
        assert abs(taken - mine[0]["target"]) <= 15                      # half of the longest document
        placed = sorted((p, r["size"]) for r in mine for p in r["positions"])
        before = 0
        for p, n in placed:                                            # the inverse of the integral of the rate
            u = (before + n / 2) / mine[0]["target"]
            want = (1 - math.sqrt(max(0, 1 - u))) / 2 if s == "a" else u
            assert p == pytest.approx(want, abs=1e-9)
            before += n
    order = [r["doc_id"] for r in mixing.training_order(m).collect()]
    assert order == [d for _, d in sorted((p, r["doc_id"]) for r in got for p in r["positions"])]


def test_full_sources_pass_their_excess_on(spark):
    rows = [(1, "w " * 10, "small"), (2, "w " * 100, "big"), (3, "w " * 100, "big"), (4, "w " * 50, None)]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    # big weighs 1, small 2, null 3 of 260: small is full at 30, null at 150; big gets the rest.
    assert {r["source"]: r["target"] for r in m.collect()} == {"big": 80.0, "small": 30.0, None: 150.0 * 1.0}


# --- 2: context-tree weighting ---------------------------------------------------

def _kt(a, b):
    return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - 2 * math.lgamma(.5)


def _stream(text):
    return b"".join(w + b" " for w in (text or "").lower().encode().split()) + b"\n"


class Tree:
    """Plain recursion over a dictionary of nodes (context, decisions so far)."""

    def __init__(self, texts, depth):
        self.depth, self.n, self.seen = depth, defaultdict(lambda: [0, 0]), Counter()
        for t in texts:
            s = b"\n" * depth + _stream(t)
            for i in range(depth, len(s)):
                for d in range(depth + 1):
                    ctx = s[i - d:i]
                    self.seen[ctx] += 1
                    for j in range(8):
                        self.n[ctx, (1 << j) | (s[i] >> (8 - j))][s[i] >> (7 - j) & 1] += 1
        self.children = defaultdict(list)
        for ctx, node in self.n:
            if ctx:
                self.children[ctx[1:], node].append((ctx, node))

    def deep(self, key):
        return sum(self.pw(k) for k in self.children[key])

    def pw(self, key):
        kt = _kt(*self.n[key])
        return kt if len(key[0]) == self.depth else np.logaddexp(kt, self.deep(key)) - math.log(2)

    def p(self, ctx, d, node, bit):
        key = (ctx[len(ctx) - d:], node)
        a, b = self.n[key]
        own = ((b if bit else a) + .5) / (a + b + 1)
        longer = (ctx[len(ctx) - d - 1:], node)
        if d == self.depth or longer not in self.n or self.seen[longer[0]] < 2:
            return own
        w = 1 / (1 + math.exp(self.deep(key) - _kt(a, b)))
        return w * own + (1 - w) * self.p(ctx, d + 1, node, bit)

    def score(self, text):
        s, total = b"\n" * self.depth + _stream(text), 0.0
        for i in range(self.depth, len(s)):
            for j in range(8):
                node, bit = (1 << j) | (s[i] >> (8 - j)), s[i] >> (7 - j) & 1
                total += math.log10(self.p(s[i - self.depth:i], 0, node, bit) if (b"", node) in self.n else .5)
        return total


@pytest.mark.parametrize("depth", [1, 2, 4])
@pytest.mark.parametrize("bounds", [{}, {"least": 2}])
def test_ctw_equals_plain_recursion(spark, depth, bounds):
    """By default every context counts."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    got = {r[0]: r[1] for r in lm_score.score(docs, F.col("doc_id") > 3, depth=depth, **bounds).select("row.doc_id", "score").collect()}
    tree = (Tree if bounds else WholeTree)(TEXTS[:4], depth)
    for i, t in enumerate(TEXTS):
        assert got[i] == pytest.approx(tree.score(t), rel=1e-4), (i, t)


@pytest.mark.parametrize("max_nodes", [2_000_000, 40, 0])
def test_ctw_is_a_distribution(spark, max_nodes):
    """Probabilities of all bytes after a context add up to 1, inside and outside the
    tree, however small a part of it is kept."""
    docs = spark.createDataFrame([(1, "abra cadabra abra")], "doc_id long, text string")
    model = lm_score.train(lm_score.blocks(docs, F.lit(False)), depth=3, max_nodes=max_nodes, max_known=max_nodes)
    for ctx in (b"bra", b"zzz", b"\nab"):
        g = np.array([int.from_bytes(ctx[::-1] + bytes([b]), "big") for b in range(256)], np.uint64)
        assert (10 ** lm_score.evaluate(g, model["tree"].value, 3)).sum() == pytest.approx(1, abs=1e-4)


class WholeTree(Tree):
    """Contexts seen once count as well."""

    def __init__(self, texts, depth):
        super().__init__(texts, depth)
        self.seen = defaultdict(lambda: 2)


def test_query_uses_contexts_seen_once(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in queries.QUERIES["op2_ctw_score"](spark, str(tmp_path)).collect()}
    tree = WholeTree([t for i, t in enumerate(TEXTS) if not rows[i]["held_out"]], 5)
    for i, t in enumerate(TEXTS):
        assert rows[i]["score"] == pytest.approx(tree.score(t), rel=1e-5), (i, t)


@pytest.mark.parametrize("bounds", [{"max_nodes": 0, "max_known": 0}, {"max_nodes": 400, "max_known": 30},
                                    {"max_nodes": 0, "max_known": 0, "least": 2}, {"max_nodes": 400, "max_known": 30, "least": 2}])
def test_no_bound_cuts_the_tree(spark, bounds):
    """However little a task takes at a time, texts are scored by the whole tree."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    got = {r[0]: r[1] for r in lm_score.score(docs, F.col("doc_id") > 3, depth=4, **bounds).select("row.doc_id", "score").collect()}
    tree = (Tree if "least" in bounds else WholeTree)(TEXTS[:4], 4)
    for i, t in enumerate(TEXTS):
        assert got[i] == pytest.approx(tree.score(t), rel=1e-5), (i, t)


def test_a_byte_against_very_many_has_a_finite_score(spark):
    """After 20 million bytes of one kind another one is rare, not impossible."""
    n = 20_000_000
    docs = spark.range(1).select(F.lit(0).cast("long").alias("doc_id"), F.repeat(F.lit("a"), n).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(1, "``"), (2, "a`a``")], docs.schema))
    got = {r[0]: r[1] for r in lm_score.score(docs, F.col("doc_id") > 0, depth=1).select("row.doc_id", "score").collect()}
    # The second "`" follows a byte that was not seen: seven decisions as in "a", the eighth against all of them.
    root = math.log10(.5 / (n + 1))
    assert all(math.isfinite(x) for x in got.values()) and root * 6 < got[1] < root and got[2] < root


def test_base_scores_and_held_out_gain(spark):
    rows = queries.QUERIES["op2_ctw_score"](spark, SF_SMALL).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    words = {d: [*(t or "").encode().lower().split(), None] for d, t in docs.items()}
    c = Counter(w for d in docs if not held[d] for w in words[d])
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(x in c for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0


def test_blocks_cut_anywhere_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(60)
    held = F.col("doc_id") % 5 == 0
    whole = {r[0]: r[1:] for r in lm_score.score(docs, held, depth=2).select("row.doc_id", "n_known", "base_score", "score").collect()}
    small = lm_score.blocks
    monkeypatch.setattr(lm_score, "BLOCK", 4000)
    cut = {r[0]: r[1:] for r in lm_score.score(docs, held, depth=2).select("row.doc_id", "n_known", "base_score", "score").collect()}
    assert small is lm_score.blocks and set(cut) == set(whole)
    for d in whole:
        assert cut[d] == pytest.approx(whole[d], rel=1e-6)


def test_a_block_takes_less_than_its_text(spark, monkeypatch):
    """What executors hold and move of a block, which before was more than its text."""
    monkeypatch.setattr(lm_score, "BLOCK", 200_000)
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.choice((3, 5, 7)))) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, [1 / i for i in range(1, 5001)], k=20_000)) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    cut = lm_score.blocks(docs, F.col("doc_id") > 9)
    size, n = sum(map(len, texts)), cut.count()
    assert n >= 6 and cut.drop("row").toArrow().nbytes < 0.6 * size
    assert len(cut.inputFiles()) == n
    model = lm_score.train(cut, 5, max_known=0)
    answers = lm_score._answered(cut, model, spark.sparkContext.broadcast(model["known"]), 5).toArrow()
    asked = model["answers"].count()
    assert answers.num_rows == n and answers.nbytes < 0.75 * n * asked * 12


# --- 4: language ID --------------------------------------------------------------

def test_language_id_on_held_out_rows(spark):
    got = queries.QUERIES["op4_language_id"](spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_bundles_equal_letter_by_letter_products():
    text, dim, n = "Été, été 42 zoo", 64, 3
    s = [0, *map(ord, "été"), 0, *map(ord, "été"), 0, *map(ord, "zoo"), 0]
    want = np.zeros(dim)
    for i in range(len(s) - n + 1):
        v = np.ones(dim)
        for k in range(n):
            v *= np.roll(langid._letter(s[i + k], dim, 1), n - 1 - k)
        want += v
    assert np.array_equal(langid.bundle([(0, text)], 1, dim, n, 1)[0], want)


# --- 6: rollups --------------------------------------------------------------------

def test_token_rollup_equals_recounting(spark):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want, seen = Counter(), set()
    for r in sorted(spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        t = r["text"] or ""
        if t in seen:
            continue
        seen.add(t)
        if t == t.upper() and t != t.lower():
            t = t.lower()
        for name, n in (("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", t))), ("byte_bpe_50k-1", len(enc.encode_ordinary(t)))):
            want[r["source"], r["lang"], name, "docs"] += 1
            want[r["source"], r["lang"], name, "tokens"] += n
    got = Counter()
    for r in queries.QUERIES["op6_token_rollup"](spark, SF_SMALL).collect():
        for k in ("docs", "tokens"):
            got[r["source"], r["lang"], r["tokenizer"], k] += r[k]
    assert got == want


def test_broken_batch_is_written_over(spark, tmp_path):
    state = token_counts.Rollup(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(1, "a", "en", "w", 5), (2, "a", "en", "w", 7)], "doc_id long, source string, lang string, tokenizer string, tokens long")
    rows.withColumn("docs", F.lit(1).cast("long")).write.parquet(f"{state.path}/deltas/b1")      # broke off before its commit
    assert state.totals().count() == 0
    assert state.commit("b1", stated=rows)
    assert [tuple(r) for r in state.totals().collect()] == [("a", "en", "w", 2, 12)]
    state.commit("b2", stated=rows.where("doc_id = 1").withColumn("tokens", F.lit(9).cast("long")).withColumn("source", F.lit("b")))
    want = {("a", "en", "w", 1, 7), ("b", "en", "w", 1, 9)}
    assert {tuple(r) for r in state.totals().collect()} == want
    assert state.compact("c1") and not state.compact("c1")
    assert {tuple(r) for r in state.totals().collect()} == want and not state.commit("b1", stated=rows)
    state.commit("b3", deleted=rows.where("doc_id = 2").select("doc_id"))
    assert [tuple(r) for r in state.totals().collect()] == [("b", "en", "w", 1, 9)]
    assert state.compact("c2") and [tuple(r) for r in state.totals().collect()] == [("b", "en", "w", 1, 9)]


def test_one_batch_is_written_at_a_time(spark, tmp_path):
    from pyspark.errors import PySparkException

    schema = "doc_id long, source string, lang string, tokenizer string, tokens long"
    state, other = (token_counts.Rollup(spark, str(tmp_path / "s")) for _ in range(2))
    rows = spark.createDataFrame([(1, "a", "en", "w", 5), (2, "a", "en", "w", 7)], schema)
    state.commit("b1", stated=rows)
    revised = rows.withColumn("tokens", F.lit(9).cast("long"))
    broken = revised.withColumn("tokens", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(PySparkException):
        state.commit("b2", stated=broken)
    assert state.writers() == ["b2"]
    for run in (lambda: other.commit("b3", stated=revised), lambda: other.compact("c1")):
        with pytest.raises(token_counts.Busy, match="b2"):
            run()
    assert other.writers() == ["b2"] and [tuple(r) for r in other.totals().collect()] == [("a", "en", "w", 2, 12)]
    assert other.commit("b2", stated=revised) and other.writers() == []           # run again, by whomever
    with pytest.raises(PySparkException):
        state.commit("b4", stated=broken)
    other.release("b4")
    assert other.commit("b3", deleted=rows.where("doc_id = 1").select("doc_id")) and other.compact("c1")
    assert [tuple(r) for r in state.totals().collect()] == [("a", "en", "w", 1, 9)] and state.writers() == []
    for name in ("begin", "", "a*", "x/y", "_hidden", ".hidden", "a b", "{a,b}"):
        with pytest.raises(ValueError):
            state.commit(name, stated=rows)


def test_the_bound_on_languages_is_a_parameter(spark):
    rows = spark.createDataFrame([(f"text {i}", f"l{i}") for i in range(5)], "text string, lang string")
    with pytest.raises(ValueError, match="more than 4"):
        langid.learn(rows, dim=64, most_languages=4)
    assert langid.learn(rows, dim=64, most_languages=5)["langs"] == [f"l{i}" for i in range(5)]


# --- 8: sharding ---------------------------------------------------------------------

def test_shards_are_near_equal_and_follow_the_order(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = sharding.shard(docs, 8, snap=0).select("row.doc_id", "row.text", "size", "text_crc32", "shard", "slot", "digest").collect()
    total = sum(r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        by[r["shard"]].append(r)
    before = 0
    for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):
        assert r["shard"] == min(7, math.floor((before + r["size"] / 2) * 8 / total))
        before += r["size"]
    order = [(r["digest"], r["doc_id"]) for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    for s in by.values():
        assert abs(sum(r["size"] for r in s) - total / 8) <= largest
        assert sorted(r["slot"] for r in s) == list(range(len(s)))


def test_small_groups_are_not_cut(spark):
    docs = spark.createDataFrame([(i, f"text number {i // 3}") for i in range(3000)], "doc_id long, text string").repartition(5)
    rows = sharding.shard(docs, 7).select("row.text", "shard").collect()
    homes = defaultdict(set)
    for r in rows:
        homes[r["text"]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


# --- 9: SimHash -------------------------------------------------------------------------

def _fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    s = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def _classes(values, radius):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in np.nonzero(np.bitwise_count(values[:i] ^ values[i]) <= radius)[0]:
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def _planted(n, seed):
    """Random points, balls of near points and chains."""
    rng = random.Random(seed)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n // 8):
        x = rng.choice(out)
        for _ in range(rng.randint(1, 6)):
            out.append(flip(x, rng.randint(1, 4)))
            if rng.random() < .5:
                x = out[-1]
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("depth", [0, 1, 4, 6])
def test_tree_loses_no_link(depth):
    pts = _planted(700, depth)
    vantage, radii = simhash.build_tree(pts[::2], 3, depth)
    leaves, at, home = simhash.route(pts, vantage, radii, 3)
    assert np.array_equal(np.sort(at[home]), np.arange(len(pts)))
    label = np.arange(len(pts))
    for leaf in np.unique(leaves):
        here = leaves == leaf
        u, v = simhash.leaf_links(pts[at[here]], home[here], 3, block=2000)
        simhash._join(label, np.searchsorted(pts, u), np.searchsorted(pts, v))
    assert label.tolist() == _classes(pts, 3)


@pytest.mark.parametrize("n_home, n_guest", [(1, 1), (1, 0), (3, 2), (2, 0), (1, 4)])
def test_chunked_leaves_lose_no_link(n_home, n_guest):
    pts = _planted(400, 9)
    vantage, radii = simhash.build_tree(pts, 3, 2)
    leaves, at, home = simhash.route(pts, vantage, radii, 3)
    label, size = np.arange(len(pts)), len(radii) + 1
    i, a, b = simhash.groups(leaves, home, pts[at], np.full(size, n_home), np.full(size, max(n_guest, 1)))
    for key in {(x, y, z) for x, y, z in zip(leaves[i], a, b)}:
        here = i[(leaves[i] == key[0]) & (a == key[1]) & (b == key[2])]
        assert len(set(here)) == len(here)
        u, v = simhash.leaf_links(pts[at[here]], home[here], 3)
        simhash._join(label, np.searchsorted(pts, u), np.searchsorted(pts, v))
    assert label.tolist() == _classes(pts, 3)


@pytest.mark.parametrize("chunk", [250_000, 10])
def test_components_over_a_tree(spark, chunk):
    pts = _planted(300, 5)
    rows = [(i, int(np.int64(np.uint64(p)))) for i, p in enumerate(pts)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, fp long").select(F.struct("doc_id").alias("row"), F.col("doc_id").alias("rid"), "fp")
    got = {r["fp"]: r["component_id"] for r in simhash.components(df, 3, leaf=32, sample=100, chunk=chunk).collect()}
    ids = dict((fp, i) for i, fp in rows)
    label = _classes(pts, 3)
    for i, p in enumerate(pts):
        fp = int(np.int64(p))
        assert got[fp] == min(ids[int(np.int64(q))] for q, x in zip(pts, label) if x == label[i])


def test_fingerprints_and_components_of_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_simhash"](spark, SF_SMALL).collect()}
    pts = np.array([_fingerprint(d["text"]) for d in docs], np.uint64)
    label = _classes(pts, 3)
    for i, d in enumerate(docs):
        assert got[d["doc_id"]]["fingerprint"] == f"{int(pts[i]):016x}"
        assert got[d["doc_id"]]["component_id"] == min(e["doc_id"] for j, e in enumerate(docs) if label[j] == label[i])


# --- 10: pseudonyms -----------------------------------------------------------------------

def _luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms_are_valid_linked_distinct_and_invertible(spark):
    rng = random.Random(1)
    cards = []
    while len(cards) < 60:
        c = str(rng.randint(10 ** 12, 10 ** 19 - 1))
        if _luhn(c):
            cards.append(c)
    dates = [f"{rng.randint(1800, 2199)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" for _ in range(60)]
    phones = [f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(0, 9999):04d}" for _ in range(60)]
    ips = [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(60)]
    values = cards + dates + phones + ips
    texts = [f"see {v} and again {v}; {values[(i * 7) % len(values)]}." for i, v in enumerate(values)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.pseudonymise(docs, "key").select("row.doc_id", "text", "kinds").collect()
    told = {}
    for r in out:
        a, b = re.fullmatch(r"see (.*) and again (.*); .*\.", r["text"], re.S).groups()
        assert a == b and len(r["kinds"]) == 3
        told[values[r["doc_id"]]] = a
    assert len(set(told.values())) == len(set(values)) and all(k != v for k, v in told.items())
    for r in out:                                                             # the third value is linked to its own document's
        third = re.fullmatch(r".*; (.*)\.", r["text"], re.S).group(1)
        assert third == told[values[(r["doc_id"] * 7) % len(values)]]
    for c in cards:
        assert _luhn(told[c]) and len(told[c]) == len(c) and told[c][0] == c[0]
    import datetime
    for d in dates:
        datetime.date.fromisoformat(told[d])
    for p in phones:
        assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", told[p])
    for i in ips:
        assert all(0 <= int(o) <= 255 for o in told[i].split("."))
    back = pii.pseudonymise(spark.createDataFrame([(r["doc_id"], r["text"]) for r in out], "doc_id long, text string"), "key", back=True)
    assert {r[0]: r[1] for r in back.select("row.doc_id", "text").collect()} == dict(enumerate(texts))
    other = pii.pseudonymise(docs, "another key").select("row.doc_id", "text").collect()
    assert {r[0]: r[1] for r in other} != {r["doc_id"]: r["text"] for r in out}


def test_neighbouring_numbers_are_told_apart(spark):
    text = "4337166598464399 42.144.35.254 4041-8949-7460-8795 +1 (988) 555-2485 4337166598464399 1999/12/31 31-12-1999 99.99.1"
    r = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    assert r["kinds"] == ["card", "ip", "card", "phone", "card", "date", "date"]
    new = r["text"].split(" ")
    assert new[0] == new[6] != "4337166598464399" and new[-1] == "99.99.1" and re.fullmatch(r"\d{4}/\d\d/\d\d", new[-3])
    assert not set(new[:-1]) & set(text.split(" ")[:-1]) - {"+1"}


@pytest.mark.parametrize("value, text", [
    ("ES91 2100 0418 4502 0005 1332", "{} BIC CAIXESBB"), ("AT611904300234573201", "{} EUR"), ("BE68539007547034", "{} 2024"),
    ("DE89 3704 0044 0532 0130 00", "REF AB12 {} EUR"), ("PL61109010140000071219812874", "{} PLN 20"), ("NO93 8601 1117 947", "to {} NOK"),
    ("ES91 2100 0418 4502 0005 1332", "{}"), ("4111 1111 1111 1111", "2024 {}"), ("4111-1111-1111-1111", "{}-2024"),
    ("4111 1111 1111 1111", "2024 2025 {} 12/26, {}"), ("4111 1111 1111 1111", "AT61 {} é")])
def test_neighbours_hide_no_value(spark, value, text):
    r = pii.pseudonymise(spark.createDataFrame([(1, text.replace("{}", value))], "doc_id long, text string"), "k").first()
    kind = "card" if value[0] == "4" else "iban"
    new = re.fullmatch(re.escape(text).replace(r"\{\}", "(.+?)", 1).replace(r"\{\}", r"\1"), r["text"]).group(1)
    assert r["kinds"] == [kind] * text.count("{}") and new != value and re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", value)
    if kind == "card":
        assert _luhn(re.sub("[^0-9]", "", new))
    else:
        flat = new.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def test_month_first_dates_are_permuted_whole(spark):
    import datetime
    days = [datetime.date(1800, 1, 1) + datetime.timedelta(i) for i in range(146097)]
    days = [d for d in days if d.day > 12]
    old = {i: f"{d.month:02d}{'/-'[i % 2]}{d.day:02d}{'/-'[i % 2]}{d.year}" for i, d in enumerate(days)}
    out = pii.pseudonymise(spark.createDataFrame(list(old.items()), "doc_id long, text string"), "k").select("row.doc_id", "text", "kinds")
    rows = out.collect()
    assert all(r["kinds"] == ["date"] and r["text"][2] == old[r["doc_id"]][2] for r in rows)
    assert sorted(datetime.datetime.strptime(r["text"].replace("-", "/"), "%m/%d/%Y").date() for r in rows) == days
    assert sum(r["text"][:5] == old[r["doc_id"]][:5] for r in rows) < 1000
    back = pii.pseudonymise(out.select("doc_id", "text"), "k", back=True).select("row.doc_id", "text").collect()
    assert {r[0]: r[1] for r in back} == old


def test_one_date_has_one_pseudonym_in_all_formats(spark):
    import datetime
    days = [datetime.date(1800, 1, 1) + datetime.timedelta(i * 37) for i in range(3948)] + [datetime.date(2000, 2, 29), datetime.date(2199, 12, 31)]
    formats = ["%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y"]
    rows = [(i, "; ".join(d.strftime(f) for f in formats[:5 if d.day > 12 else 4])) for i, d in enumerate(days)]
    out = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").select("row.doc_id", "text").collect()
    told = {}
    for r in out:
        new = {datetime.datetime.strptime(t, f).date() for t, f in zip(r["text"].split("; "), formats)}
        assert len(new) == 1 and (min(new).day > 12) == (days[r["doc_id"]].day > 12)
        told[days[r["doc_id"]]] = min(new)
    assert len(set(told.values())) == len(set(days)) == len(told)


def test_days_up_to_the_12th_are_permuted_whole(spark):
    import datetime
    days = [datetime.date(y, m, d) for y in range(1800, 2200) for m in range(1, 13) for d in range(1, 13)]
    docs = spark.createDataFrame([(i, d.isoformat()) for i, d in enumerate(days)], "doc_id long, text string")
    assert sorted(r["text"] for r in pii.pseudonymise(docs, "k").collect()) == [d.isoformat() for d in days]


class Pseudonyms:
    """The rules by hand: left to right, every place, first format that fits there."""

    def __init__(self, key):
        self.key = key

    def hash(self, tweak, i, half):
        return hashlib.sha256(f"{self.key}|{tweak}|{i}|{half}|{self.key}".encode()).hexdigest()

    def permute(self, tweak, x, y, a, b):
        for i in range(8):
            if i % 2 == 0:
                x = (x + int(self.hash(tweak, i, y)[:15], 16) % a) % a
            else:
                y = (y + int(self.hash(tweak, i, x)[:15], 16) % b) % b
        return x, y

    def halves(self, tweak, digits):
        u = len(digits) // 2
        x, y = self.permute(tweak, int(digits[:u] or 0), int(digits[u:]), 10 ** u, 10 ** (len(digits) - u))
        return (f"{x:0{u}d}" if u else "") + f"{y:0{len(digits) - u}d}"

    def mail(self, user):
        u = len(user) // 2
        sides = [user[:u], user[u:]]
        for i in range(8):
            h, out = self.hash("mail", i, sides[1 - i % 2]), ""
            for j, c in enumerate(sides[i % 2]):
                by = int(h[j % 32 * 2:j % 32 * 2 + 2], 16)
                first, size = (48, 10) if c in "0123456789" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (0, 0)
                out += chr((ord(c) - first + by) % size + first) if size else c
            sides[i % 2] = out
        return "".join(sides)

    def date(self, day):
        import datetime
        days = [datetime.date(1800, 1, 1) + datetime.timedelta(i) for i in range(146097)]
        if not hasattr(self, "late"):
            self.late = [d for d in days if d.day > 12]
            self.early = [d for d in days if d.day <= 12]
        own, tweak, b = (self.late, "month", 9833) if day.day > 12 else (self.early, "low", 240)
        x, y = self.permute(tweak, own.index(day) // b, own.index(day) % b, len(own) // b, b)
        return own[x * b + y]

    def value(self, kind, v):
        import datetime
        refill = lambda new: re.sub("[0-9A-Za-z]", lambda m, i=iter(new): next(i), v)
        d = re.sub("[^0-9]", "", v)
        if kind == "email":
            user, host = v.split("@")
            return "email", f"{self.mail(user)}@{host}"
        if kind == "iban":
            flat = v.replace(" ", "")
            number = lambda s: int("".join(str(int(c, 36)) for c in s))
            if number(flat[4:] + flat[:4]) % 97 != 1:
                return None
            new = self.halves("iban", re.sub("[^0-9]", "", flat[4:]))
            body = re.sub("[0-9]", lambda m, i=iter(new): next(i), flat[4:])
            return "iban", refill(f"{flat[:2]}{98 - number(body + flat[:2] + '00') % 97:02d}{body}")
        if kind in ("ymd", "dmy"):
            sep = re.sub("[0-9]", "", v)[0]
            for f in ("%Y-%m-%d",) if kind == "ymd" else ("%d-%m-%Y", "%m-%d-%Y")[:1 if sep == "." else 2]:
                try:
                    day = datetime.datetime.strptime(v.replace(sep, "-"), f).date()
                except ValueError:
                    continue
                if 1800 <= day.year < 2200:
                    return "date", self.date(day).strftime(f).replace("-", sep)
            return None
        if kind == "ssn":
            a, b, c = int(d[:3]), int(d[3:5]), int(d[5:])
            if not (1 <= a < 900 and a != 666 and b and c):
                return None
            areas = [i for i in range(1, 900) if i != 666]
            x, y = self.permute("ssn", areas.index(a) * 99 + b - 1, c - 1, 88902, 9999)
            return "ssn", f"{areas[x // 99]:03d}-{x % 99 + 1:02d}-{y + 1:04d}"
        if kind == "ip":
            o = v.split(".")
            if any(int(p) > 255 or (p != "0" and p[0] == "0") for p in o):
                return None
            x, y = self.permute("ip", int(o[0]) * 256 + int(o[1]), int(o[2]) * 256 + int(o[3]), 65536, 65536)
            return "ip", f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
        if kind == "phone":
            t = d[-10:]
            x, y = self.permute("phone", (int(t[:3]) - 200) * 100 + int(t[6:8]), (int(t[3:6]) - 200) * 100 + int(t[8:]), 80000, 80000)
            return "phone", refill(f"{d[:-10]}{x // 100 + 200}{y // 100 + 200}{x % 100:02d}{y % 100:02d}")
        if not _luhn(d) or not d.strip("0"):
            return None
        inner = d[0] + self.halves("card", d[1:-1])
        return "card", refill(inner + next(c for c in "0123456789" if _luhn(inner + c)))

    def text(self, text):
        out, kinds, i = "", [], 0
        whole = {k: re.compile(p, re.A) for k, p in pii.FORMATS.items()}
        begin = re.compile(pii.VALUE, re.A)
        while i < len(text):
            m = begin.match(text, i)
            new = m and self.value(next(k for k in whole if whole[k].fullmatch(m[0])), m[0])
            if new:
                kinds.append(new[0])
            out += new[1] if new else text[i]
            i = m.end() if new else i + 1
        return out, kinds


def test_pseudonyms_equal_the_rules_by_hand(spark):
    hand = Pseudonyms("op10")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_pseudonymise"](spark, SF_SMALL).collect()}
    assert got.keys() == docs.keys()
    seen = Counter()
    for i, t in docs.items():
        if t is None:
            assert got[i]["text"] is None
            continue
        text, kinds = hand.text(t)
        assert got[i]["text"] == text and got[i]["n_values"] == len(kinds)
        assert all(got[i][f"n_{k}"] == kinds.count(k) for k in ("email", "card", "phone", "ip", "iban", "ssn", "date"))
        seen.update(kinds)
    assert len(seen) >= 4
    text = ("1999-12-31, 31.12.1999 12/31/1999 01-02-2003 29.02.2001 DE89 3704 0044 0532 0130 00 536-22-1234 666-22-1234 10.0.0.255 256.1.1.1 "
            "4111 1111 1111 1111 4111 1111 1111 1112 (988) 555-2485 Ann.B9@mail.example.org 2024 4111 1111 1111 1111")
    r = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "op10").first()
    assert (r["text"], list(r["kinds"])) == hand.text(text) and len(set(r["kinds"])) == 7


def test_a_text_of_very_many_values_takes_linear_time(spark):
    import time
    text = " ".join(f"{1900 + i % 90}-{i % 12 + 1:02d}-{i % 28 + 1:02d}" for i in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begun = time.time()
    r = pii.pseudonymise(docs, "k").first()
    assert len(r["kinds"]) == 100_000 and len(r["text"]) == len(text) and time.time() - begun < 120


def test_no_plan_shows_the_key(spark):
    docs = spark.createDataFrame([(1, "1999-12-31")], "doc_id long, text string")
    out = pii.pseudonymise(docs, "a-very-secret-key")
    out.collect()
    assert "secret" not in out._jdf.queryExecution().toString()


def test_two_halves_are_permuted_exactly(spark):
    n = spark.range(6 * 7).select(F.col("id"), pii._permute("k", "t", (F.col("id") / 7).cast("long"), F.col("id") % 7, F.lit(6), F.lit(7)).alias("p"))
    assert sorted(r["p"]["l"] * 7 + r["p"]["r"] for r in n.collect()) == list(range(42))


# --- pipeline ---------------------------------------------------------------------------------

def test_pipeline_equals_its_stages_by_hand(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    kept = [d for d in sorted(docs) if any(map(str.isalpha, docs[d]["text"] or ""))]
    pts = np.array([_fingerprint(docs[d]["text"]) for d in kept], np.uint64)
    label = _classes(pts, 3)
    kept = [d for i, d in enumerate(kept) if label.index(label[i]) == i]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i:i + 10]) for w in map(words, items) if w for i in range(max(1, len(w) - 9))}
    assert all(len(w) == 10 for w in windows)
    kept = [d for d in kept if not any(tuple(w[i:i + 10]) in windows for w in [words(docs[d]["text"])] for i in range(len(w) - 9))]
    stage3 = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where(F.col("doc_id").isin(kept))
    want = Counter()
    for r in mixing.mix(stage3).select("doc_id", "copies").collect():
        want[r["doc_id"]] += r["copies"]
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert Counter(r["doc_id"] for r in got) == +want
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
