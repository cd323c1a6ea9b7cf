"""NULL and order cases that decide results, and the fixed
reference faults (SURVEY 2.14)."""

import pytest
from pyspark.sql import functions as F

from migrakit.operators import grants as G
from migrakit.operators.copying import needs_copy
from migrakit.operators.projections import attributes_wide, explode_list, stringify, with_list_size
from migrakit.operators.sync import plan_sync, sync_report, views_of
from migrakit.operators.verify import split_outcomes, verify_counts
from migrakit.sources.tables import records, union_all


def test_needs_copy_is_three_valued(spark):
    inv = records(spark, [
        ("d", "a", None, "delta"),      # NULL location, other provider -> dropped
        ("d", "b", None, "hive"),       # NULL location, legacy provider -> kept
        ("d", "c", "", "delta"),        # no Location row ('') -> kept
        ("d", "e", "s3://x/e", "delta"),  # on the object store -> dropped
        ("d", "f", "s3://x/f", "hive"),   # legacy provider -> kept
        ("d", "g", "dbfs:/m/g", None),    # not on the object store -> kept
    ], "database string, table_name string, location string, provider string")
    got = sorted(r.table_name for r in needs_copy(inv).collect())
    assert got == ["b", "c", "f", "g"]


def test_needs_copy_skips_views_and_temporaries(spark):
    inv = records(spark, [("d", "v", "dbfs:/v", "delta", "VIEW", False),
                          ("d", "t", "dbfs:/t", "delta", "TABLE", True),
                          ("d", "k", "dbfs:/k", "delta", "TABLE", None)],
                  "database string, table_name string, location string, provider string, "
                  "table_type string, is_temporary boolean")
    assert [r.table_name for r in needs_copy(inv).collect()] == ["k"]


def test_null_counts_get_unknown_and_lost_tables_show(spark):
    s = records(spark, [("d", "a", 1), ("d", "b", 2), ("d", "c", None), ("d", "e", 4), ("d", "l", 5)],
                "database string, table_name string, n long")
    t = records(spark, [("d", "a", 1), ("d", "b", 3), ("d", "c", 3), ("d", "e", None), ("d", "x", 1)],
                "database string, table_name string, n long")
    got = {r.table_name: r.verdict for r in verify_counts(s, t).collect()}
    assert got == {"a": "match", "b": "mismatch", "c": "unknown", "e": "unknown",
                   "l": "missing", "x": "extra"}
    ok, bad = split_outcomes(verify_counts(s, t))
    assert ok.count() == 1 and bad.count() == 5


def test_split_outcomes_puts_null_status_in_bad_part(spark):
    df = records(spark, [("a", "success"), ("b", "failed"), ("c", None)], "v string, status string")
    ok, bad = split_outcomes(df, "status", "success")
    assert [r.v for r in ok.collect()] == ["a"]
    assert sorted(r.v for r in bad.collect()) == ["b", "c"]


def test_dedup_ignores_privilege_order(spark):
    df = records(spark, [("p", "table", "c.s.t", ["SELECT", "MODIFY"]),
                         ("p", "table", "c.s.t", ["MODIFY", "SELECT"])],
                 "principal string, securable_type string, securable_name string, "
                 "permission_list array<string>")
    rows = G.dedup_grants(df).collect()
    assert len(rows) == 1 and rows[0].permission_list == ["MODIFY", "SELECT"]


def _grants(spark, rows):
    return records(spark, rows, "schema_name string, table_name string, principal string, "
                                "object_type string, action_type string")


def test_translation_rules(spark):
    g = _grants(spark, [
        ("s", "t", "p", "CATALOG$", "OWN"), ("s", "t", "p", "CATALOG$", "READ_METADATA"),
        ("s", "t", "p", "CATALOG$", "CREATE"), ("s", "t", "p", "CATALOG$", "USAGE"),
        ("s", "t", "q", "DATABASE", "OWN"), ("s", "t", "q", "DATABASE", "READ_METADATA"),
        ("s", "t", "q", "DATABASE", "CREATE"), ("s", "t", "q", "DATABASE", "CREATE_NAMED_FUNCTION"),
        ("s", "t", "r", "TABLE", "SELECT"), ("s", "t", "r", "TABLE", "OWN"),
        ("s", "t", "u", "TABLE", "OWN"),                # translates to nothing -> no row
        ("s", "t", "users", "TABLE", "SELECT"),         # excluded principal
        ("s", "t", None, "TABLE", "MODIFY"),            # NULL principal passes the test
        ("s", "t", "v", "ANY_FILE", "SELECT"),          # unknown level -> nothing
    ])
    t = G.translate_privileges(G.grants_by_principal(g), "main")
    got = {(r.principal, r.object_level): (r.securable_type, r.securable_name, r.permission_list)
           for r in t.collect()}
    assert got == {
        ("p", "CATALOG$"): ("catalog", "main", ["BROWSE", "CREATE SCHEMA", "CREATE TABLE", "USAGE"]),
        ("q", "DATABASE"): ("schema", "main.s", ["CREATE FUNCTION", "CREATE TABLE"]),
        ("r", "TABLE"): ("table", "main.s.t", ["SELECT"]),
        (None, "TABLE"): ("table", "main.s.t", ["MODIFY"]),
    }


def test_usage_closure_then_dedup_has_no_duplicates(spark):
    g = _grants(spark, [("s", f"t{i}", "p", "TABLE", "SELECT") for i in range(5)]
                + [("s", "t0", "p", "DATABASE", "CREATE")])
    u = G.with_usage(G.translate_privileges(G.grants_by_principal(g), "main"), "main")
    d = G.dedup_grants(u)
    rows = d.collect()
    keys = [(r.principal, r.securable_type, r.securable_name, tuple(r.permission_list)) for r in rows]
    assert len(keys) == len(set(keys))
    assert ("p", "catalog", "main", ("USAGE",)) in keys
    assert ("p", "schema", "main.s", ("USAGE",)) in keys
    assert ("p", "schema", "main.s", ("CREATE TABLE",)) in keys
    assert len([k for k in keys if k[1] == "table"]) == 5
    changes = G.grant_changes(d).collect()
    assert all(c.body.startswith('{"changes":[{"principal":"p","add":[') for c in changes)


def test_rules_as_a_frame_are_joined(spark):
    g = records(spark, [("s", "t", "p", "TABLE", ["MODIFY", "SELECT"]), ("s", None, "p", "DATABASE", ["OWN", "X"])],
                "schema_name string, table_name string, principal string, object_level string, permission_list array<string>")
    rules = records(spark, [("TABLE", "SELECT", ["SELECT", "READ"]), ("DATABASE", "OWN", None)]
                    + [("TABLE", f"P{i}", ["X"]) for i in range(20000)],
                    "level string, privilege string, result array<string>")
    got = {r.securable_name: r.permission_list for r in G.translate_privileges(g, "main", rules).collect()}
    assert got == {"main.s.t": ["READ", "SELECT"], "main.s": ["X"]}


def test_a_null_part_names_no_object(spark):
    g = records(spark, [(None, "t1", "p", "TABLE", ["SELECT"]), ("s", "t1", "p", "TABLE", ["SELECT"])],
                "schema_name string, table_name string, principal string, object_level string, permission_list array<string>")
    assert [r.securable_name for r in G.translate_privileges(g, "main").collect()] == ["main.s.t1"]


def test_tables_by_schema_lists_empty_schemas(spark):
    inv = records(spark, [("a", "t1", False), ("a", "t2", None), ("a", "t3", True), ("b", "t4", False)],
                  "database string, table_name string, is_temporary boolean")
    got = {r.schema_name: r.table_count for r in G.tables_by_schema(inv, ["a", "b", "c"]).collect()}
    assert got == {"a": 2, "b": 1, "c": 0}
    assert G.tables_of(inv).count() == 3


def test_attributes_wide_last_ordinal_wins_and_missing_is_blank(spark):
    df = records(spark, [(1, 1, "Provider", "hive"), (1, 3, "Provider", "delta"), (1, 2, "Type", "MANAGED"),
                         (2, 1, "View Text", "SELECT 1")],
                 "entity int, ordinal int, attr string, val string")
    got = {r.entity: r.asDict() for r in attributes_wide(df, ["Provider", "Type", "View Text"]).collect()}
    assert got[1] == {"entity": 1, "Provider": "delta", "Type": "MANAGED", "View_Text": ""}
    assert got[2]["View_Text"] == "SELECT 1" and got[2]["Provider"] == ""


def test_union_all_is_balanced_and_fills_missing_columns(spark):
    parts = [spark.range(i, i + 1).select(F.col("id").alias("a")) for i in range(7)]
    parts.append(spark.range(1).select(F.lit("x").alias("b")))
    u = union_all(parts)
    assert u.count() == 8 and set(u.columns) == {"a", "b"}


def test_sync_plan_status_codes(spark):
    src = records(spark, [
        ("d", "new", "s3://b/new", "delta", "TABLE", False),
        ("d", "same", "s3://b/same", "delta", "TABLE", False),
        ("d", "chg", "s3://b/chg", "delta", "TABLE", False),
        ("d", "v", None, None, "VIEW", False),
        ("d", "root", "dbfs:/root", "delta", "TABLE", False),
        ("d", "legacy", "s3://b/legacy", "hive", "TABLE", False),
        ("d", "tmp", "s3://b/tmp", "delta", "TABLE", True),
    ], "database string, table_name string, location string, provider string, table_type string, "
       "is_temporary boolean")
    dst = records(spark, [("d", "same", "delta"), ("d", "chg", "parquet"), ("d", "gone", "delta")],
                  "database string, table_name string, provider string")
    plan = plan_sync(src, dst)
    got = {r.source_name: r.status_code for r in plan.collect()}
    assert got == {"new": "TO_CREATE", "same": "EXISTS", "chg": "CHANGED", "v": "VIEWS_NOT_SUPPORTED",
                   "root": "UNSUPPORTED", "legacy": "UNSUPPORTED", "tmp": "UNSUPPORTED", "gone": "ORPHAN"}
    report = {(r.dimension, r.value): r.n for r in sync_report(plan).collect()}
    assert report[("status_code", "UNSUPPORTED")] == 3
    assert report[("source_type", None)] == 1 and report[("source_type", "TABLE")] == 6
    assert [r.source_name for r in views_of(plan).collect()] == ["v"]


def test_stringify_and_list_helpers(spark):
    df = spark.createDataFrame([(1, ["a", "b"], {"k": "v"})], "id int, l array<string>, m map<string,string>")
    s = stringify(df).first()
    assert s.id == "1" and s.l == '["a","b"]' and s.m == '{"k":"v"}'
    assert with_list_size(df, "l", "n").first().n == 2
    assert explode_list(df, "l", "x").count() == 2
    empty = spark.createDataFrame([(1, [])], "id int, l array<string>")
    assert explode_list(empty, "l").count() == 0 and explode_list(empty, "l", keep_empty=True).count() == 1


def test_plan_copy_sums_partial_counts(spark):
    from migrakit.operators.copying import plan_copy
    inv = records(spark, [("d", "a", "dbfs:/a", "delta"), ("d", "b", "dbfs:/b", "delta"), ("d", "c", "", "csv")],
                  "database string, table_name string, location string, provider string")
    counts = records(spark, [("d", "a", 2), ("d", "a", 3), ("d", "b", 1), ("d", "b", None)],
                     "database string, table_name string, n long")
    got = {r.table_name: r.source_count for r in plan_copy(inv, counts, "s3://t").collect()}
    assert got == {"a": 5, "b": None, "c": None}


def test_privilege_sets_as_bits(spark):
    """Known names are bits, other names go beside them; NULL keys and names, repeats,
    groups of either kind alone; a vocabulary that cannot be bits is refused."""
    rows = [("s", "t", "p", "TABLE", a) for a in ("USAGE", "SELECT", "SELECT", "zeta", "Alpha", "zeta", None)]
    rows += [(None, None, None, None, "OWN"), (None, None, None, None, "odd"), (None, "t", "p", "TABLE", None),
             ("s", "u", "p", "TABLE", "odd"), ("s", "v", "p", "TABLE", "MODIFY"), ("s", "v", None, "TABLE", "MODIFY")]
    g = records(spark, rows, "schema_name string, table_name string, principal string, object_type string, action_type string")
    want = {}
    for *key, name in rows:
        want.setdefault(tuple(key), set()).update([name] if name else [])
    want = {k: sorted(v) for k, v in want.items()}
    for vocabulary in (G.VOCABULARY, ("SELECT",), tuple(f"w{i:02}" for i in range(G.MOST_BITS)), ("Alpha", "MODIFY", "SELECT", "odd", "zeta")):
        got = G.grants_by_principal(g, vocabulary).collect()
        assert len(got) == len(want) and {tuple(r[:4]): r.permission_list for r in got} == want
    all_bits = spark.range(G.MOST_BITS).selectExpr("null s", "null t", "'p' p", "'x' o", "concat('w', lpad(id, 2, '0')) a").toDF(*g.columns)
    r, = G.grants_by_principal(all_bits, tuple(f"w{i:02}" for i in range(G.MOST_BITS))).collect()
    assert len(r.permission_list) == G.MOST_BITS and r.permission_list == sorted(r.permission_list)
    assert G.grants_by_principal(g.limit(0)).count() == 0
    for bad in (tuple(f"w{i:02}" for i in range(64)), ("b", "a"), ("a", "a")):
        with pytest.raises(ValueError):
            G.grants_by_principal(g, bad)
