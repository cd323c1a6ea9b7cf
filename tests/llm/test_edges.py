"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and
clashing extra columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from migrakit.llm import (decontaminate, exact_dedup, langid, line_dedup, lm_score, mixing, pii, sharding, simhash,
                          token_counts)
from migrakit.session import work_dir

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, rk string, size int, rid int, "
          "fp int, shard int, words string, spans string, found string, lang_id string, gid int, block int, copies int")
LINE = "this very line is shared by many documents"
LONG = "\n".join(f"long line number {i} with some words in it" for i in range(4000))


def _row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), "r", "k", 1, 2, 3, 4, "w", "s", "f", "l", 5, 6, 7)


ROWS = [_row(1, f"{LINE}\nfirst"), _row(2, f"{LINE}\nsecond"), _row(3, None), _row(4, ""), _row(None, f"{LINE}\nno id"),
        _row(5, "same text here again", None, None), _row(6, "same text here again", "de", "b"),
        _row(6, "same text here again", "de", "b"), _row(7, " \t\n\x0b\x0c\r "), _row(8, LONG), _row(9, "ÉTÉ Straße İx 4111111111111111"),
        _row(10, "!!! ???", "en", "c"), _row(None, None, None, None), _row(11, "samE  text\there again")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "Same text here"), (2, None), (3, ""), (None, "here again"), (4, "Same text here")],
                                 "item_id long, text string")


def _by_id(df, *cols):
    out = {}
    for r in df.select("row.doc_id", *cols).collect():
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return out


def test_mix(docs, none):
    got = mixing.mix(docs)
    rows = _by_id(got, "size", "source_size", "target", "copies")
    assert sum(map(len, rows.values())) == len(ROWS)
    assert rows[3][0][:3] == rows[4][0][:3] and rows[3][0][0] == 0
    assert rows[10][0][0] == 2
    for v in rows.values():
        for size, source_size, target, copies in v:
            assert copies <= 3 and target <= 3 * source_size
    order = mixing.training_order(got)
    assert order.columns == docs.columns and order.count() == got.agg(F.sum("copies")).first()[0]
    assert mixing.mix(none).count() == 0 and mixing.training_order(mixing.mix(none)).count() == 0


def test_lm_score(docs, none):
    got = _by_id(lm_score.score(docs, F.lit(False), depth=3), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert got[3] == got[4] == got[7] and got[3][0][:2] == (1, 1)
    assert all(x[4] < 0 for v in got.values() for x in v) and got[6][0] == got[6][1]
    assert lm_score.score(none, F.lit(False), depth=3).count() == 0
    untrained = lm_score.score(docs, F.lit(True), depth=3).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in untrained)
    assert all(abs(r["score"] + r["n_bytes"] * 8 * 0.30102999566) < 1e-6 * r["n_bytes"] * 8 for r in untrained)


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs, first_digit=4, max_digit=64)
    rows = _by_id(got, "keep_id", "group_size", "kept")
    # 5, 6, 6 equal; "samE" differs; null, empty and blank texts equal: the blank one is longest.
    assert rows[5] == [(5, 3, True)] and rows[6] == [(5, 3, False)] * 2
    assert rows[11] == [(11, 1, True)] and rows[7] == [(7, 4, True)]
    assert rows[3] == rows[4] == [(7, 4, False)]
    assert exact_dedup.exact_dedup(none).count() == 0


def test_language_id(docs, none):
    model = langid.learn(docs, dim=256)
    assert model["langs"] == ["de", "en"]
    got = {(r["doc_id"], r["text"]): r["guess"] for r in langid.identify(docs, model, "guess").collect()}
    for text in (None, "", "!!! ???", " \t\n\x0b\x0c\r "):
        assert all(g["lang"] == "und" and g["score"] == 0 for (d, t), g in got.items() if t == text)
    assert got[(6, "same text here again")]["lang"] in ("de", "en") and 0 <= got[(6, "same text here again")]["score"] <= 1
    assert langid.learn(none, dim=256)["langs"] == []
    assert {r["guess"]["lang"] for r in langid.identify(docs, langid.learn(none, dim=256), "guess").collect()} == {"und"}
    assert langid.identify(none, model, "guess").count() == 0


def test_line_dedup(docs, none):
    rows = _by_id(line_dedup.dedup_lines(docs), "text", "n_lines", "n_dropped")
    assert rows[1] == [(f"{LINE}\nfirst", 2, 0)] and rows[2] == [("second", 2, 1)]
    assert sorted(rows[None]) == [("", 1, 0), ("no id", 2, 1)]
    assert rows[3] == rows[4] == [("", 1, 0)]
    assert rows[5] == [("same text here again", 1, 0)] and rows[6] == [("", 1, 1)] * 2     # repeated rows are one document
    assert rows[8][0][0] == LONG
    assert line_dedup.dedup_lines(none).count() == 0


def test_decontaminate(docs, none, items, spark):
    rows = _by_id(decontaminate.contamination(docs, items), "n_words", "n_hit", "items")
    assert rows[5] == [(4, 4, ["", "1", "4"])] and rows[6] == rows[5] * 2 and rows[11] == rows[5]
    assert rows[3] == [(0, 0, [])] and rows[9][0][0] == 4
    kept = decontaminate.without_documents(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4
    cleaned = {r["doc_id"]: r["text"] for r in decontaminate.without_spans(docs, items.where("item_id = 1")).collect()}
    assert cleaned[11] == "again" and cleaned[2] == f"{LINE}\nsecond" and cleaned[3] is None
    empty = items.limit(0)
    assert decontaminate.contamination(docs, empty).where("contaminated").count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    many = decontaminate.contamination(docs, items, block=1)
    assert _by_id(many, "n_words", "n_hit", "items") == rows


def test_sharding(docs, none):
    got = sharding.shard(docs, shards=4)
    rows = [r.asDict() for r in got.select("row.doc_id", "size", "shard", "slot", "text_crc32").collect()]
    assert len(rows) == len(ROWS)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (3, 4)} == {(1, 0)}
    assert sharding.shard(none, shards=4).count() == 0


def test_simhash(docs, none):
    rows = _by_id(simhash.near_duplicates(docs), "fp", "component_id")
    assert rows[3] == rows[4] == rows[7] == [(0, 3)] and rows[5] == [(rows[5][0][0], 5)] and rows[6] == rows[5] * 2
    assert rows[11][0][1] == 5                      # case and white space do not count
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 5, 8, 9, 10]
    assert simhash.near_duplicates(none).count() == 0 and simhash.dedup(none).count() == 0


def test_pii(docs, none):
    rows = _by_id(pii.pseudonymise(docs, "k"), "text", "kinds")
    assert rows[3] == [(None, [])] and rows[4] == [("", [])] and rows[8][0] == (LONG, [])
    assert rows[9][0][1] == ["card"] and "4111111111111111" not in rows[9][0][0]
    assert pii.pseudonymise(none, "k").count() == 0


def test_token_counts(spark, docs, none):
    state = token_counts.Rollup(spark, work_dir(spark, "tests", "rollup"))
    rows = token_counts.counted(docs, {"w": token_counts.WORDS})
    assert state.commit("a", stated=rows) and not state.commit("a", stated=rows)
    first = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in state.totals().collect()}
    assert first[("b", "de")] == (2, 8) and first[(None, None)][0] == 2
    assert sum(d for d, _ in first.values()) == len(ROWS)
    assert state.commit("b", stated=token_counts.counted(none, {"w": token_counts.WORDS}), deleted=none.select("doc_id"))
    assert {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in state.totals().collect()} == first
    state.commit("c", deleted=docs.select("doc_id"))
    assert state.totals().count() == 0 and state.ledger().count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, none, k, tmp_path_factory):
    items = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, "nothing of the kind in any of these documents")], "item_id long, text string").write.parquet(f"{items}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs, str(items))
    assert got.columns == ([c for c in docs.columns if c != "shard"] + ["shard", "slot"] if k == 4 else docs.columns)
    got.write.parquet(f"{items}/out")
    assert spark.read.parquet(f"{items}/out").count() >= 8
    assert stage(spark, none, str(items)).count() == 0


def test_language_stage_rejects_long_texts_like_no_language(spark):
    texts = [f"the cat and the dog of house number {i} went to the river" for i in range(40)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(90, "ЖЩЪ " * 60, None), (91, "Жщ", None), (92, "... 12", "en")]
    kept = {r[0] for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    assert kept == {*range(40), 91}


def test_shards_follow_part_numbers(spark, tmp_path):
    for part in (2, 10, 100000):
        spark.range(part, part + 3).selectExpr("id AS doc_id", "cast(id AS string) AS text").coalesce(1).write.parquet(f"{tmp_path}/x{part}")
        import glob
        import os
        os.makedirs(f"{tmp_path}/all", exist_ok=True)
        os.link(glob.glob(f"{tmp_path}/x{part}/part-*.parquet")[0], f"{tmp_path}/all/part-{part:05d}-a.parquet")
    got = corpus_pipeline.shards(spark, spark.read.parquet(f"{tmp_path}/all"), "").orderBy("shard", "slot").collect()
    assert [r["doc_id"] for r in got] == [2, 3, 4, 10, 11, 12, 100000, 100001, 100002]


def test_many_hits_in_one_text(spark):
    """Time is linear in the hits of a text: 100,000 in seconds."""
    import time
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, " x ".join([item] * 33_400)), (2, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "w3 w4")], "item_id long, text string")
    start = time.time()
    got = {r[0]: tuple(r)[1:] for r in decontaminate.contamination(docs, items).select("row.doc_id", "n_words", "n_hit", F.size("spans")).collect()}
    assert got[2][:2] == (1, 0)
    assert got[1] == (33_400 * 13 - 1, 33_400 * 12, 33_400) and time.time() - start < 60


def test_executors_need_not_have_the_package(tmp_path):
    """A session started in a folder from which the workers cannot import it."""
    import subprocess
    import sys

    import migrakit

    root = migrakit.__file__.rsplit("/", 2)[0]
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from migrakit.llm import simhash
docs = spark.createDataFrame([(1, "a b c d"), (2, "A  b c d")], "doc_id long, text string")
print("KEPT", simhash.dedup(docs).count())
"""
    import os
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "KEPT 1" in out.stdout, out.stderr[-2000:]
