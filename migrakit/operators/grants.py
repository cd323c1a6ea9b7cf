"""Grants algebra: table lists per schema (G1), privileges per principal
(A3/G2), translation to the new privilege model (G3), implied usage grants
(G4), deduplication (G5/A5) and the change table (G6)."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import records

# How a privilege of the legacy model translates, per object
# level.  (level, privilege, new privileges); an empty list drops it.
TRANSLATION_RULES = (
    ("CATALOG$", "OWN", ()),
    ("CATALOG$", "READ_METADATA", ("BROWSE",)),
    ("CATALOG$", "CREATE_NAMED_FUNCTION", ("CREATE FUNCTION",)),
    ("CATALOG$", "CREATE", ("CREATE SCHEMA", "CREATE TABLE")),
    ("DATABASE", "READ_METADATA", ()),
    ("DATABASE", "OWN", ()),
    ("DATABASE", "CREATE_NAMED_FUNCTION", ("CREATE FUNCTION",)),
    ("DATABASE", "CREATE", ("CREATE TABLE",)),
    ("TABLE", "SELECT", ("SELECT",)),
    ("TABLE", "MODIFY", ("MODIFY",)),
)
# Levels whose privileges without a rule pass unchanged; at any
# other level (TABLE, unknown, NULL) they are dropped.
KEEP_UNLISTED = ("CATALOG$", "DATABASE")
# The principal whose grants are not carried over.
EXCLUDED_PRINCIPAL = "users"
# Legacy level -> securable type of the new model.
SECURABLE_TYPES = (("CATALOG$", "catalog"), ("DATABASE", "schema"), ("TABLE", "table"))
USAGE = "USAGE"
#: The privileges that a set of privileges holds as bits, in the order of their names.
VOCABULARY = tuple(sorted({privilege for _, privilege, _ in TRANSLATION_RULES} | {USAGE}))
#: Bits of a long without its sign.
MOST_BITS = 63

GRANT_KEYS = ("schema_name", "table_name", "principal", "object_level")


def tables_by_schema(inventory: DataFrame, schemas: Iterable[str] | None = None,
                     database: str = "database") -> DataFrame:
    """Number of non-temporary tables per schema: (schema_name,
    table_count).  With ``schemas``, every listed schema appears, 0 when it
    has none.  The table names stay as flat rows (``tables_of``): no list of
    a whole schema is ever built in one row or task."""
    inv = inventory
    if "is_temporary" in inv.columns:
        inv = inv.where(~F.coalesce(F.col("is_temporary"), F.lit(False)))
    counts = inv.groupBy(F.col(database).alias("schema_name")).agg(
        F.count(F.lit(1)).alias("table_count"))
    if schemas is None:
        return counts
    wanted = records(inventory.sparkSession, [(s,) for s in schemas], "schema_name string")
    return wanted.join(counts, "schema_name", "left").select(
        "schema_name", F.coalesce("table_count", F.lit(0)).cast("long").alias("table_count"))


def tables_of(inventory: DataFrame, database: str = "database", table: str = "table_name") -> DataFrame:
    """J6 on the table list: (schema_name, table_name) of non-temporary tables."""
    inv = inventory
    if "is_temporary" in inv.columns:
        inv = inv.where(~F.coalesce(F.col("is_temporary"), F.lit(False)))
    return inv.select(F.col(database).alias("schema_name"), F.col(table).alias("table_name"))


def bits_of(name: Column, vocabulary: Sequence[str] = VOCABULARY) -> Column:
    """The bit of a privilege; 0 for a NULL and for one that the vocabulary does not hold."""
    if len(vocabulary) > MOST_BITS or list(vocabulary) != sorted(set(vocabulary)):
        raise ValueError(f"a vocabulary is at most {MOST_BITS} different names in order")
    bit = F.lit(0).cast("long")
    for i, word in reversed(list(enumerate(vocabulary))):
        bit = F.when(name == word, F.lit(1 << i).cast("long")).otherwise(bit)
    return bit


def names_of(bits: Column, vocabulary: Sequence[str] = VOCABULARY) -> Column:
    """The privileges of a set of bits, sorted by name."""
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(word))
                                     for i, word in enumerate(vocabulary)], F.lit(None).cast("string")))


def grants_by_principal(grants: DataFrame, vocabulary: Sequence[str] = VOCABULARY) -> DataFrame:
    """The set of privileges per (schema, table, principal, level), sorted.

    Privileges of ``vocabulary`` (at most 63 names in order) are bits, put together
    by one hash aggregation with map-side partial aggregation: a group is one
    number, however many rows it has.  Other names take a path of their own, each
    once per group, and are joined to the sets (NULL keys match), so none is lost;
    where there are none, the join meets an empty side."""
    rows = grants.select("schema_name", "table_name", "principal", F.col("object_type").alias("object_level"), "action_type")
    bits = rows.groupBy(*GRANT_KEYS).agg(F.bit_or(bits_of(F.col("action_type"), vocabulary)).alias("_bits"))
    others = rows.where(F.col("action_type").isNotNull() & ~F.col("action_type").isin(*vocabulary)).distinct()
    others = others.groupBy(*[F.col(k).alias(f"_{k}") for k in GRANT_KEYS]).agg(F.collect_list("action_type").alias("_others"))
    known = names_of(F.col("_bits"), vocabulary)
    return bits.join(others, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in GRANT_KEYS], "left").select(
        *GRANT_KEYS, F.when(F.col("_others").isNull(), known).otherwise(F.array_sort(F.concat(known, "_others"))).alias("permission_list"))


def translation_expr(level: Column, privilege: Column,
                     rules: Sequence[tuple] = TRANSLATION_RULES,
                     keep_unlisted: Sequence[str] = KEEP_UNLISTED) -> Column:
    """G3 for one privilege: array of 0..n new privileges."""
    expr = None
    for lvl, priv, out in rules:
        res = F.array(*[F.lit(x) for x in out]) if out else F.array().cast("array<string>")
        cond = (level == lvl) & (privilege == priv)
        expr = F.when(cond, res) if expr is None else expr.when(cond, res)
    keep = level.isin(list(keep_unlisted))
    none = F.array().cast("array<string>")
    if expr is None:
        return F.when(keep, F.array(privilege)).otherwise(none)
    return expr.when(keep, F.array(privilege)).otherwise(none)


def securable(level: Column, catalog: str, schema: Column, table: Column) -> tuple[Column, Column]:
    """(securable_type, securable_name) of a grant at ``level``."""
    typ = None
    for lvl, t in SECURABLE_TYPES:
        typ = F.when(level == lvl, t) if typ is None else typ.when(level == lvl, t)
    # concat, not concat_ws: a NULL part must not give the name of another object.
    name = (F.when(level == "CATALOG$", F.lit(catalog))
             .when(level == "DATABASE", F.concat(F.lit(f"{catalog}."), schema))
             .when(level == "TABLE", F.concat(F.lit(f"{catalog}."), schema, F.lit("."), table)))
    return typ, name


def translate_privileges(grouped: DataFrame, catalog: str, rules: Sequence[tuple] | DataFrame = TRANSLATION_RULES,
                         keep_unlisted: Sequence[str] = KEEP_UNLISTED,
                         excluded: str = EXCLUDED_PRINCIPAL) -> DataFrame:
    """Translate each privilege list to the new model.

    Rows of the excluded principal are dropped (a NULL principal is kept, as
    it passes ``!=``); rows whose list translates to nothing are dropped, and
    rows whose securable has a NULL part, which names no object.  Adds
    securable_type and securable_name.  Built-in rules are a per-row expression:
    no shuffle.  ``rules`` may be a frame (level, privilege, result array<string>)
    of any size: it is joined on (level, privilege)."""
    level = F.col("object_level")
    kept = grouped.where(~F.col("principal").eqNullSafe(excluded))
    if isinstance(rules, DataFrame):
        none = F.array().cast("array<string>")
        r = rules.toDF("_level", "_priv", "_out")
        flat = kept.select(*GRANT_KEYS, F.explode("permission_list").alias("_p"))
        hit = flat.join(r, (F.col("_level") == level) & (F.col("_priv") == F.col("_p")), "left")
        out = (F.when(F.col("_level").isNotNull(), F.coalesce("_out", none))
               .when(level.isin(list(keep_unlisted)), F.array("_p")).otherwise(none))
        kept = hit.select(*GRANT_KEYS, F.explode(out).alias("_n")).distinct().groupBy(*GRANT_KEYS).agg(
            F.array_sort(F.collect_list("_n")).alias("permission_list"))
        new = F.col("permission_list")
    else:
        new = F.array_sort(F.array_distinct(F.flatten(F.transform(
            "permission_list", lambda p: translation_expr(level, p, rules, keep_unlisted)))))
    typ, name = securable(level, catalog, F.col("schema_name"), F.col("table_name"))
    out = kept.select(*GRANT_KEYS, typ.alias("securable_type"), name.alias("securable_name"),
                      new.alias("permission_list"))
    named = F.col("securable_name").isNotNull() | F.col("securable_type").isNull()
    return out.where((F.size("permission_list") > 0) & named)


def with_usage(translated: DataFrame, catalog: str) -> DataFrame:
    """A TABLE grant adds USAGE on its schema and its catalog; a DATABASE
    grant adds USAGE on the catalog.  One generate per row: no shuffle."""
    lvl = F.col("object_level")
    usage = F.array(F.lit(USAGE))
    own = F.struct(F.col("securable_type").alias("t"), F.col("securable_name").alias("n"),
                   F.col("permission_list").alias("p"))
    on_schema = F.when(lvl == "TABLE", F.struct(
        F.lit("schema").alias("t"), F.concat(F.lit(f"{catalog}."), F.col("schema_name")).alias("n"),
        usage.alias("p")))
    on_catalog = F.when(lvl.isin("TABLE", "DATABASE"), F.struct(
        F.lit("catalog").alias("t"), F.lit(catalog).alias("n"), usage.alias("p")))
    items = F.filter(F.array(own, on_schema, on_catalog), lambda x: x.isNotNull())
    return translated.select(*GRANT_KEYS, F.explode(items).alias("g")).select(
        *GRANT_KEYS, F.col("g.t").alias("securable_type"), F.col("g.n").alias("securable_name"),
        F.col("g.p").alias("permission_list"))


def dedup_grants(df: DataFrame) -> DataFrame:
    """One row per (principal, securable, sorted privilege list).

    Lists are sorted first, so the same set in another order is a duplicate.
    Only the key columns are kept, so the result does not depend on which
    duplicate survives.  Partial aggregation removes most duplicates (e.g.
    the catalog USAGE of every table grant) before the shuffle."""
    return df.select("principal", "securable_type", "securable_name",
                     F.array_sort("permission_list").alias("permission_list")).distinct()


def grant_changes(df: DataFrame) -> DataFrame:
    """The change to apply per securable and principal: (securable_type,
    securable_name, principal, add, body) with ``body`` the JSON change
    request.  Rows without a principal cannot be applied and are left out."""
    body = F.to_json(F.struct(F.array(F.struct(F.col("principal").alias("principal"),
                                               F.col("permission_list").alias("add"))).alias("changes")))
    return df.where(F.col("principal").isNotNull()).select(
        "securable_type", "securable_name", "principal", F.col("permission_list").alias("add"),
        body.alias("body"))
