"""Where two tables differ: ranges and keys against brute force."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from migrakit.operators import locate
from migrakit.operators.locate import differing_ranges, differing_rows, locate_differences
from migrakit.operators.verify import verify_copies
from migrakit.sources.tables import TableRef, records

SCHEMA = "a int, b string, v map<string,int>"
ROWS = [(i % 40, f"b{i}" if i % 3 else None, {"x": i, "y": 1}) for i in range(400)] + [(None, None, None)] * 3


def brute(left, right, digits):
    """{key: (range, rows of the left, rows of the right, kind)} of the keys that differ."""
    def held(rows):
        out = {}
        for a, b, v in rows:
            out.setdefault((a, b), Counter())[tuple(sorted((v or {}).items())) if v is not None else None] += 1
        return out
    x, y = held(left), held(right)
    out = {}
    for k in x.keys() | y.keys():
        p, q = x.get(k, Counter()), y.get(k, Counter())
        if p != q:
            place = hashlib.md5("|".join("null" if c is None else str(c) for c in k).encode()).hexdigest()
            kind = "missing" if not q else "extra" if not p else "changed"
            out[k] = (place[:digits], p.total(), q.total(), kind)
    return out


def faulty():
    rows = [r for r in ROWS if r != ROWS[17]]                       # a row lost
    rows[40] = (rows[40][0], rows[40][1], {"x": -1})                # a value changed
    return rows[:-1] + [rows[5], (99, "new", None)]                 # repeated NULL key, a row twice, a row too many


def found(frame):
    return {(r["a"], r["b"]): (r["range"], r["source_rows"], r["target_rows"], r["kind"]) for r in frame.collect()}


def test_every_differing_key_is_named_at_every_depth(spark, tmp_path):
    a, b = records(spark, ROWS, SCHEMA), records(spark, faulty(), SCHEMA)
    for small, digits in ((10**6, 4), (0, 4 * locate.LEVELS)):
        ranges = differing_ranges(a, b, ["a", "b"], f"{tmp_path}/{small}", small)
        want = brute(ROWS, faulty(), digits)
        assert found(differing_rows(a, b, ["a", "b"], ranges)) == want
        assert {r["range"] for r in ranges.collect()} == {v[0] for v in want.values()}


def test_tables_that_differ_everywhere_stop_at_the_level_that_fits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(locate, "MOST_RANGES", 3)
    a, b = records(spark, ROWS, SCHEMA), records(spark, [(x, y, {"z": 0}) for x, y, _ in ROWS], SCHEMA)
    ranges = differing_ranges(a, b, ["a"], f"{tmp_path}/all", 0)
    assert {len(r["range"]) for r in ranges.collect()} == {4}
    got = differing_rows(a, b, ["a"], ranges).collect()
    assert len(got) == 41 and {r["kind"] for r in got} == {"changed"}


def test_equal_and_empty_tables_have_no_range(spark, tmp_path):
    a, none = records(spark, ROWS, SCHEMA), records(spark, [], SCHEMA)
    for i, (x, y) in enumerate(((a, a.orderBy(F.desc("b"))), (none, none))):
        ranges = differing_ranges(x, y, ["a", "b"], f"{tmp_path}/{i}")
        assert ranges.count() == 0 and differing_rows(x, y, ["a", "b"], ranges).count() == 0
    ranges = differing_ranges(a, none, ["a", "b"], f"{tmp_path}/gone")
    assert {r["kind"] for r in differing_rows(a, none, ["a", "b"], ranges).collect()} == {"missing"}


def test_only_wrong_copies_are_read_again(spark, tmp_path):
    for name, rows in (("src", ROWS), ("good", ROWS[::-1]), ("bad", faulty())):
        records(spark, rows, SCHEMA).write.parquet(f"{tmp_path}/{name}")
    src = TableRef("d", "good", "parquet", f"{tmp_path}/src")
    pairs = [(src, src.at(f"{tmp_path}/good")), (TableRef("d", "bad", "parquet", f"{tmp_path}/src"), TableRef("d", "bad", "parquet", f"{tmp_path}/bad")),
             (TableRef("d", "lost", "parquet", f"{tmp_path}/src"), TableRef("d", "lost", "parquet", f"{tmp_path}/nowhere", name="no.such"))]
    verdicts = verify_copies(spark, pairs)
    out = locate_differences(spark, pairs, {}, verdicts, f"{tmp_path}/ranges").collect()
    want = brute(ROWS, faulty(), 4)
    assert Counter(r["table_name"] for r in out) == Counter({"bad": len(want)})
    assert {r["key"] for r in out} == {"|".join("null" if c is None else str(c) for c in k) for k in want}
