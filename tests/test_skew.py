"""A key holding a third of all rows: results against brute force in plain
Python, and the plan shape that keeps the hot key from one task."""

from collections import defaultdict

from pyspark.sql import functions as F

from migrakit.operators import grants as G
from migrakit.operators.merge import outer_match
from migrakit.operators.projections import attributes_wide
from migrakit.operators.verify import verify_counts


def test_verify_counts_with_a_hot_table(spark):
    # One table arrives as 20,000 partial count rows (a third of all rows).
    n = 60000
    src = spark.range(n).select(
        F.lit("d").alias("database"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") % 997).cast("string")))
         .alias("table_name"),
        F.lit(1).cast("long").alias("n"))
    dst = src.groupBy("database", "table_name").agg(F.sum("n").alias("n"))
    rows = {r.table_name: r for r in verify_counts(src, dst).collect()}
    assert rows["hot"].source_count == 20000 and rows["hot"].verdict == "match"
    assert all(r.verdict == "match" for r in rows.values())
    plan = verify_counts(src, dst)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Join" not in plan


def test_outer_match_keeps_greatest_duplicate(spark):
    left = spark.range(30000).select(F.lit("k").alias("key"), F.col("id").alias("v"))
    right = spark.createDataFrame([("k", "x"), ("j", "y")], "key string, w string")
    rows = {r.key: r for r in outer_match(left, right, ["key"], [F.col("v")], [F.col("w")]).collect()}
    assert rows["k"]._l.v == 29999 and rows["k"]._r.w == "x" and rows["j"]._l is None


def _python_grants(rows, catalog):
    rules = {(lvl, p): out for lvl, p, out in G.TRANSLATION_RULES}
    groups = defaultdict(set)
    for s, t, pr, lvl, act in rows:
        groups[(s, t, pr, lvl)].add(act)
    out = set()
    for (s, t, pr, lvl), acts in groups.items():
        if pr == G.EXCLUDED_PRINCIPAL:
            continue
        new = set()
        for a in acts:
            if (lvl, a) in rules:
                new |= set(rules[(lvl, a)])
            elif lvl in G.KEEP_UNLISTED:
                new.add(a)
        if not new:
            continue
        name = {"CATALOG$": catalog, "DATABASE": f"{catalog}.{s}", "TABLE": f"{catalog}.{s}.{t}"}[lvl]
        typ = dict(G.SECURABLE_TYPES)[lvl]
        out.add((pr, typ, name, tuple(sorted(new))))
        if lvl == "TABLE":
            out.add((pr, "schema", f"{catalog}.{s}", ("USAGE",)))
        if lvl in ("TABLE", "DATABASE"):
            out.add((pr, "catalog", catalog, ("USAGE",)))
    return out


def test_grants_with_a_hot_principal_against_brute_force(spark):
    levels = ["CATALOG$", "DATABASE", "TABLE", "ANY_FILE"]
    acts = ["SELECT", "MODIFY", "READ_METADATA", "OWN", "CREATE", "CREATE_NAMED_FUNCTION", "USAGE"]
    rows = []
    for i in range(9000):
        principal = "hot" if i % 3 == 0 else ("users" if i % 11 == 0 else f"p{i % 40}")
        rows.append((f"s{i % 4}", f"t{i % 25}", principal, levels[i % 4], acts[(i // 4) % 7]))
    df = spark.createDataFrame(rows, "schema_name string, table_name string, principal string, "
                                     "object_type string, action_type string").repartition(4)
    got = G.dedup_grants(G.with_usage(G.translate_privileges(G.grants_by_principal(df), "main"), "main"))
    got = {(r.principal, r.securable_type, r.securable_name, tuple(r.permission_list)) for r in got.collect()}
    assert got == _python_grants(rows, "main")


def test_describe_pivot_with_a_hot_entity(spark):
    rows = [(1, i, "Provider", f"v{i}") for i in range(20000)] + [(2, 1, "Type", "MANAGED")]
    df = spark.createDataFrame(rows, "entity int, ordinal int, attr string, val string").repartition(4)
    got = {r.entity: (r.Provider, r.Type) for r in attributes_wide(df, ["Provider", "Type"]).collect()}
    assert got == {1: ("v19999", ""), 2: ("", "MANAGED")}


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

GRANT = st.tuples(st.sampled_from(["s1", "s2"]), st.sampled_from(["t1", "t2", "t3"]),
                  st.sampled_from(["p1", "p2", "users", None]),
                  st.sampled_from(["CATALOG$", "DATABASE", "TABLE", "ANY_FILE", None]),
                  st.sampled_from(["SELECT", "MODIFY", "READ_METADATA", "OWN", "CREATE",
                                   "CREATE_NAMED_FUNCTION", "USAGE"]))


@settings(max_examples=15, deadline=None)
@given(st.lists(GRANT, min_size=1, max_size=40))
def test_property_usage_then_dedup_has_no_duplicates(spark, rows):
    df = spark.createDataFrame(rows, "schema_name string, table_name string, principal string, "
                                     "object_type string, action_type string")
    got = G.dedup_grants(G.with_usage(G.translate_privileges(G.grants_by_principal(df), "main"), "main"))
    keys = [(r.principal, r.securable_type, r.securable_name, tuple(r.permission_list)) for r in got.collect()]
    assert len(keys) == len(set(keys))
    assert set(keys) == _python_grants(rows, "main")
