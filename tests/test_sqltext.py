"""View text qualification (V2) against the reference faults it fixes, its
two regex forms against each other, and the view cut-over with retries."""

import re
import uuid

import duckdb
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from migrakit.functions.strings import quote_ident
from migrakit.operators.sqltext import cut_over_views, dependency_levels, qualify_sql_col, qualify_sql_duckdb, view_statements
from migrakit.session import work_dir

SCHEMAS = ["sales", "hr", "cat"]
CASES = {
    "SELECT * FROM sales.t": "SELECT * FROM main.sales.t",
    "SELECT * FROM `Sales`.t": "SELECT * FROM main.Sales.t",
    "SELECT * FROM `sales`.`t`": "SELECT * FROM main.sales.`t`",
    "SELECT * FROM hive_metastore.sales.t": "SELECT * FROM main.sales.t",
    "SELECT * FROM `hive_metastore`.`sales`.t": "SELECT * FROM main.sales.t",
    "SELECT * FROM presales.t": "SELECT * FROM presales.t",           # look-alike name
    "SELECT sales FROM x": "SELECT sales FROM x",                      # word, not a qualifier
    "SELECT h.sales FROM hr.u h": "SELECT h.sales FROM main.hr.u h",   # column named like a schema
    "SELECT * FROM sales.t,hr.u": "SELECT * FROM main.sales.t,main.hr.u",
    "SELECT * FROM cat.t": "SELECT * FROM main.cat.t",                 # schema named like a catalog
    "SELECT * FROM main.sales.t": "SELECT * FROM main.sales.t",        # already qualified
    "sales.t": "main.sales.t",                                         # at the start
}


def _spark_qualify(spark, texts, schemas=SCHEMAS, catalog="main"):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(qualify_sql_col(F.col("t"), schemas, catalog)).collect()]


def test_qualify_cases(spark):
    texts = list(CASES)
    assert _spark_qualify(spark, texts) == [CASES[t] for t in texts]


def test_qualify_twice_is_once_and_duckdb_agrees(spark):
    texts = list(CASES)
    once = _spark_qualify(spark, texts)
    assert _spark_qualify(spark, once) == once
    con = duckdb.connect()
    for t in texts:
        sql = qualify_sql_duckdb("?", SCHEMAS, "main").replace("regexp_replace(?", "regexp_replace($1")
        assert con.execute(f"SELECT {sql}", [t]).fetchone()[0] == CASES[t]


def test_catalog_named_like_a_schema(spark):
    out = _spark_qualify(spark, ["SELECT * FROM hr.t", "SELECT * FROM hr.hr.t"], ["hr"], "hr")
    assert out == ["SELECT * FROM hr.hr.t", "SELECT * FROM hr.hr.t"]


def _reference(text, schemas, catalog, old=("hive_metastore",)):
    """The lexical rules, scanned by hand: what a text must become."""
    word = lambda ch: ch.isalnum() or ch == "_"
    toks, i = [], 0
    while i < len(text):
        ch, j = text[i], i + 1
        if text.startswith("--", i):
            j = text.find("\n", i) if "\n" in text[i:] else len(text)
            kind = "gap"
        elif text.startswith("/*", i) and "*/" in text[i + 2:]:
            j, kind = text.index("*/", i + 2) + 2, "gap"
        elif ch in "'\"" and ch in text[i + 1:]:
            j, kind = text.index(ch, i + 1) + 1, "text"
        elif ch.isspace():
            kind = "gap"
        elif ch == "`" and "`" in text[i + 1:]:
            j, kind = text.index("`", i + 1) + 1, "name"
        elif word(ch):
            while j < len(text) and word(text[j]):
                j += 1
            kind = "name"
        else:
            kind = "dot" if ch == "." else "other"
        toks.append([kind, text[i:j]])
        i = j
    chains, i = [], 0                                    # [text, is a chain of names, parts]
    while i < len(toks):
        kind, t = toks[i]
        if kind != "name":
            chains.append([t, kind, []])
            i += 1
            continue
        parts, end = [t], i + 1
        while end + 1 < len(toks) and toks[end][0] == "dot" and (toks[end + 1][0] == "name" or toks[end + 1][1] == "*"):
            parts.append(toks[end + 1][1])
            end += 2
        chains.append(["".join(x[1] for x in toks[i:end]), "name", parts])
        i = end
    solid = [c for c in chains if c[1] != "gap"]
    low = [c[0].lower() for c in solid]
    fold = lambda t: t.replace("`", "").lower()
    known = {s.lower() for s in schemas}
    stop = {"from", "join", "select", "where", "on", "with", "as", "and"}
    operand = lambda k: k >= 0 and low[k] not in stop and (solid[k][1] == "name" or low[k] == ")")
    at = lambda k: low[k] if 0 <= k < len(low) else ""
    own = {fold(c[0]) for k, c in enumerate(solid) if c[1] == "name" and len(c[2]) == 1 and fold(c[0]) in known and (
        at(k - 1) == "as" and operand(k - 2) or operand(k - 1) or at(k + 1) == "as" and at(k + 2) == "(" or at(k - 1) == "with")}
    out, clause, k = [], "", -1
    for c in chains:
        if c[1] == "gap":
            out.append(c[0])
            continue
        k += 1
        if c[1] == "name" and len(c[2]) == 1 and low[k] in stop - {"as", "and"}:
            clause, begin = low[k], k
        t = c[0]
        if c[1] == "name" and len(c[2]) > 1 and c[2][1:] != ["*"]:
            p = c[2]
            has_cat = len(p) > 2 and fold(p[0]) in {x.lower() for x in (*old, catalog)} and fold(p[1]) in known
            relation = clause in ("from", "join") and (k == begin + 1 or at(k - 1) == ",")
            if has_cat:
                p = p[1:]
            if has_cat or fold(p[0]) in known and (relation or fold(p[0]) not in own):
                t = ".".join([catalog, p[0].replace("`", ""), *p[1:]])
        out.append(t)
    return "".join(out)


PIECES = st.sampled_from(["sales.t", "hr.u", " `sales`.t", "main.sales.t", "hive_metastore.hr.t", "presales.t", "h.sales", "sales", "hr", "sales.*",
                          "SALES.T", "x", " ", " ", " ", ",", "(", ")", "=", "\n", " from ", " FROM ", " join ", " select ", " as ", " with ", " on ",
                          " where ", "'it sales.t'", "'hr.u'", "-- hr.u\n", "/* sales.t */", '"sales.t"', "`x` ", "1.5", "'"])


@settings(max_examples=40, deadline=None, phases=[Phase.generate])
@given(st.lists(st.lists(PIECES, min_size=1, max_size=14).map("".join), min_size=20, max_size=20))
def test_property_lexical_rules_and_idempotent(spark, texts):
    once = _spark_qualify(spark, texts, ["sales", "hr"])
    for t, got in zip(texts, once):
        assert got == _reference(t, ["sales", "hr"], "main"), t
    assert _spark_qualify(spark, once, ["sales", "hr"]) == once


def test_renames_are_simultaneous(spark):
    m = {"a": "b", "b": "c", "x": "y", "y": "x"}
    once = _spark_qualify(spark, ["SELECT * FROM a.t JOIN b.u", "SELECT * FROM x.t, Y.u", "SELECT * FROM hive_metastore.b.t"], m)
    assert once == ["SELECT * FROM `main`.`b`.t JOIN `main`.`c`.u", "SELECT * FROM `main`.`y`.t, `main`.`x`.u", "SELECT * FROM `main`.`c`.t"]
    assert _spark_qualify(spark, once, m) == once


def test_only_references_change(spark):
    cases = {
        "SELECT 'a.t', \"a.t\" FROM a.t -- a.t": "SELECT 'a.t', \"a.t\" FROM main.a.t -- a.t",
        "SELECT 'it''s a.t', 'x\\' a.t' /* a.t */ FROM b.u": "SELECT 'it''s a.t', 'x\\' a.t' /* a.t */ FROM main.b.u",
        "WITH a AS (SELECT x FROM b.t) SELECT a.x FROM a, a.u": "WITH a AS (SELECT x FROM main.b.t) SELECT a.x FROM a, main.a.u",
        "SELECT a.x FROM b.t AS a JOIN a.u ON a.x = b.u.y": "SELECT a.x FROM main.b.t AS a JOIN main.a.u ON a.x = main.b.u.y",
        "SELECT a.x FROM (SELECT * FROM b.t) a": "SELECT a.x FROM (SELECT * FROM main.b.t) a",
        "SELECT a.f(x), `a` . `t`.x, a.t.* FROM a.t": "SELECT main.a.f(x), main.a.`t`.x, main.a.t.* FROM main.a.t",
        "SELECT '" + "\\x" * 20_000 + " a.t' FROM a.t": "SELECT '" + "\\x" * 20_000 + " a.t' FROM main.a.t",
    }
    assert _spark_qualify(spark, list(cases), ["a", "b"]) == list(cases.values())
    for text in list(cases.values())[:-1]:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(text)


def test_view_statements_quote_names(spark):
    df = spark.createDataFrame([("s`1", "v", "SELECT * FROM sales.t")],
                               "schema_name string, view_name string, view_text string")
    stmt = view_statements(df, SCHEMAS, "main").first().view_stmt
    assert stmt == "CREATE OR REPLACE VIEW `main`.`s``1`.`v` AS SELECT * FROM main.sales.t"


def test_cut_over_retries_views_that_depend_on_later_views(spark):
    db = "t_" + uuid.uuid4().hex[:8]
    spark.sql(f"CREATE DATABASE {db} LOCATION '{work_dir(spark, 'tests', db)}'")
    stmts = spark.createDataFrame([
        (db, "top", f"CREATE OR REPLACE VIEW {db}.top AS SELECT * FROM {db}.mid"),
        (db, "mid", f"CREATE OR REPLACE VIEW {db}.mid AS SELECT * FROM {db}.base"),
        (db, "base", f"CREATE OR REPLACE VIEW {db}.base AS SELECT 1 AS x"),
        (db, "bad", f"CREATE OR REPLACE VIEW {db}.bad AS SELECT * FROM {db}.nowhere"),
    ], "schema_name string, view_name string, view_stmt string")
    out = {r.view_name: r for r in cut_over_views(spark, stmts).collect()}
    assert {k: v.status for k, v in out.items()} == {"top": "success", "mid": "success",
                                                     "base": "success", "bad": "failed"}
    assert out["bad"].error and len(out["bad"].error) <= 32000
    assert spark.table(f"{quote_ident(db)}.top").count() == 1


def test_trie_alternation_many_names(spark):
    from migrakit.functions.regex import alternation
    names = [f"s{i}" for i in range(300)] + ["sales", "sales_eu", "s"]
    pat = alternation(names)
    rx = re.compile("^(?:" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\x" + m.group(1).zfill(2), pat) + ")$")
    assert all(rx.match(n) for n in names) and all(rx.match(n.upper()) for n in names)
    assert not rx.match("s300") and not rx.match("sale")
    out = _spark_qualify(spark, ["SELECT * FROM sales_eu.t, S12.u, s.v, sale.w"], names)
    assert out == ["SELECT * FROM main.sales_eu.t, main.S12.u, main.s.v, sale.w"]


def test_names_that_need_quotes_parse_again(spark):
    text = "SELECT * FROM `my-schema`.t JOIN plain.u ON t.id = u.id"
    df = spark.createDataFrame([(text,)], "view_text string")
    out = df.select(qualify_sql_col(F.col("view_text"), ["my-schema", "plain"], "my-cat").alias("v")).first().v
    assert out == "SELECT * FROM `my-cat`.`my-schema`.t JOIN `my-cat`.`plain`.u ON t.id = u.id"
    spark._jsparkSession.sessionState().sqlParser().parsePlan(out)
    again = spark.createDataFrame([(out,)], "v string").select(qualify_sql_col(F.col("v"), ["my-schema", "plain"], "my-cat").alias("v"))
    assert again.first().v == out


def test_schemas_can_be_renamed(spark):
    df = spark.createDataFrame([("SELECT * FROM old.a, `Old`.b, cold.c",)], "v string")
    assert df.select(qualify_sql_col(F.col("v"), {"old": "new-1"}, "main").alias("v")).first().v == \
        "SELECT * FROM `main`.`new-1`.a, `main`.`new-1`.b, cold.c"


def test_dependency_levels_by_schema_and_view(spark):
    rows = [("s", "c", "CREATE VIEW s.c AS SELECT * FROM s.b"), ("s", "b", "CREATE VIEW s.b AS SELECT x FROM s.t WHERE x IN (SELECT y FROM m.s.a)"),
            ("s", "a", "CREATE VIEW s.a AS SELECT 's.c' AS lit"), ("r", "a", "CREATE VIEW r.a AS SELECT * FROM `S`.`C`"),
            ("s", "p", "CREATE VIEW s.p AS SELECT * FROM s.q"), ("s", "q", "CREATE VIEW s.q AS SELECT * FROM r.a JOIN s.p"),
            ("s", "w", "CREATE VIEW s.w AS WITH c AS (SELECT 1 x) SELECT * FROM c"), ("s", "z", "CREATE VIEW s.z AS SELEC nothing")]
    level, cycles = dependency_levels(spark, rows)
    assert level == {("s", "a"): 1, ("s", "b"): 2, ("s", "c"): 3, ("r", "a"): 4, ("s", "p"): 5, ("s", "q"): 5, ("s", "w"): 1, ("s", "z"): 1}
    assert set(cycles) == {("s", "p"), ("s", "q")} and cycles[("s", "p")] == "s.p, s.q"


def test_cut_over_names_a_cycle(spark):
    db = "t_" + uuid.uuid4().hex[:8]
    spark.sql(f"CREATE DATABASE {db} LOCATION '{work_dir(spark, 'tests', db)}'")
    stmts = spark.createDataFrame([(db, v, f"CREATE OR REPLACE VIEW {db}.{v} AS SELECT * FROM {db}.{w}") for v, w in (("p", "q"), ("q", "p"))],
                                  "schema_name string, view_name string, view_stmt string")
    out = cut_over_views(spark, stmts).collect()
    assert all(r.status == "failed" and r.error.startswith(f"reads itself through {db}.p, {db}.q: ") for r in out)
