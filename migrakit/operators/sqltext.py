"""SQL text of views: qualify schema names with the new catalog (V2, J4),
build the statements (V3, P5) and create the views with retries (K5)."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parallel import let
from ..functions.regex import alternation, re2_replacement
from ..functions.strings import bounded_text, quote_ident, quote_ident_col
from ..sources.tables import records

# Fixed value: the legacy catalog prefix dropped from view texts.
LEGACY_CATALOG = "hive_metastore"

# --- lexical rules ---------------------------------------------------------
# Quantifiers are possessive (Java), so that long literals need no deep stack.
_GAP = r"(?:\s++|--[^\n]*+|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/)"
_NAME = r"(?:`[^`]*+(?:``[^`]*+)*+`|[A-Za-z0-9_\x{80}-\x{10ffff}]++)"
_CHAIN = _NAME + r"(?:\s*+\.\s*+(?:" + _NAME + r"|\*))*+"
_STRING = "'[^'\\\\]*+(?:\\\\[\\s\\S][^'\\\\]*+)*+'"
_TOKEN = "(" + _GAP + "*+)(" + _STRING + "|" + _STRING.replace("'", '"') + "|" + _CHAIN + r"|[\s\S]|\z)"

#: Keywords that begin a clause; after those of ``_RELATIONS`` a comma-separated list of relations follows.
_RELATIONS = ("from", "join", "table", "into")
_CLAUSES = (*_RELATIONS, "select", "where", "on", "using", "group", "having", "order", "union", "intersect", "except",
            "with", "lateral", "values", "window", "limit", "qualify", "set", "cluster", "distribute", "sort", "pivot")
#: Words after which a bare name is no alias.
_NO_ALIAS = (*_CLAUSES, "distinct", "all", "and", "or", "not", "in", "is", "like", "between", "by", "case", "when", "then",
             "else", "end", "as", "left", "right", "full", "inner", "outer", "cross", "natural", "semi", "anti", "recursive")


def _clauses(text: Column) -> Column:
    """The text cut where a clause begins (never inside a literal, a comment or a
    longer name)."""
    word = "(?i:" + "|".join(_CLAUSES) + r")(?![A-Za-z0-9_.`\x{80}-\x{10ffff}])"
    token = "(?:" + _GAP + "|" + _STRING + "|" + _STRING.replace("'", '"') + "|" + _CHAIN + r"|[\s\S])"
    return F.regexp_extract_all(text, F.lit("(" + token + "(?:(?!" + word + ")" + token + ")*+)"), F.lit(1))


def _folded(token: Column) -> Column:
    """A name as it is compared: without back-quotes, letters small."""
    return F.lower(F.replace(token, F.lit("`"), F.lit("")))


def _head(schemas: Iterable[str], catalog: str, old_catalogs: Sequence[str]) -> str:
    """A chain of names that begins with a schema, or with a catalog and a schema.
    Group 1: the catalog; group 2: the schema."""
    prefix = "(?:`?(" + alternation([*old_catalogs, catalog]) + r")`?\s*\x{2e}\s*)?"
    return "^" + prefix + "`?(" + alternation(schemas) + r")`?\s*\x{2e}\s*"


def _maybe(schemas: Iterable[str]) -> str:
    """Whether a text can hold a schema's name before a dot at all: a lookahead on
    the possible first characters rejects most positions at once."""
    schemas = list(schemas)
    first = sorted({ch for n in schemas for ch in (n[0].lower(), n[0].upper())} | {"`"})
    return ("(?=[" + "".join("\\x{%x}" % ord(ch) if not ch.isalnum() else ch for ch in first) + "])(?<![A-Za-z0-9_`.])`?(?:"
            + alternation(schemas) + r")`?\s*\x{2e}|\x{2e}\s*`?(?:" + alternation(schemas) + r")`?\s*\x{2e}")


def _plain(name: str) -> bool:
    """Whether a name needs no back-quotes."""
    return bool(re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name))


def _quoted(catalog: str, schema: str) -> bool:
    return not (_plain(catalog) and _plain(schema))


def qualify_sql_col(text: Column, schemas: Iterable[str] | dict[str, str], catalog: str,
                    old_catalogs: Sequence[str] = (LEGACY_CATALOG,)) -> Column:
    """V2/X5/J4 as a column: schema names in the text of a query put under the
    new catalog, in one lexical pass.

    The text is read as tokens (literals, comments, chains of names, single
    characters); only a chain can change, and each is looked up once, so
    ``schemas`` may map old names to new ones in any way (chains and swaps of
    names included).  A chain ``schema.name`` (bare, back-quoted, or after an old
    or the new catalog) becomes ``catalog.schema.name``, back-quoted where either
    name needs it.  A chain that begins with the name of a common table
    expression or an alias of the same text is left alone, unless it stands
    where a relation is named or comes after a catalog.

    A second run changes nothing: a name under the new catalog stays if it is a
    new name.  The schema list is small and travels in the plan as a literal."""
    names = dict(schemas) if isinstance(schemas, dict) else {s: None for s in schemas}
    head = _head(names, catalog, old_catalogs)
    fixed = {old.lower(): f"{quote_ident(catalog)}.{quote_ident(new or old)}." for old, new in names.items()
             if new is not None or _quoted(catalog, old)}
    stays = sorted({new.lower() for new in names.values() if new is not None} & {n.lower() for n in names})
    is_schema = "^`?(?:" + alternation(names) + ")`?$"

    def prefix(name: Column) -> Column:
        bare = F.concat(F.lit(catalog + "."), name, F.lit("."))
        if not fixed:
            return bare
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv]), F.lower(name)), bare)

    def renamed(chain: Column, free: Column) -> Column:
        cat, name = F.regexp_extract(chain, head, 1), F.regexp_extract(chain, head, 2)
        done = (F.lower(cat) == catalog.lower()) & F.lower(name).isin(stays) if stays else F.lit(False)
        change = chain.rlike(head) & (free | (cat != "")) & ~done & ~chain.rlike("^" + _NAME + r"\s*+\.\s*+\*$")   # t.*: columns
        return F.when(change, F.concat(prefix(name), F.regexp_replace(chain, head, ""))).otherwise(chain)

    def declared(bodies: Column) -> Column:
        """Schema names that the text uses as names of its own."""
        at = lambda i: F.coalesce(F.get(bodies, i), F.lit(""))
        operand = lambda t: (t.rlike(r"^[A-Za-z0-9_`\x{80}-\x{10ffff})]") & ~F.lower(t).isin(*_NO_ALIAS))

        def own(t: Column, i: Column) -> Column:
            after_as = (F.lower(at(i - 1)) == "as") & operand(at(i - 2))
            cte = (F.lower(at(i + 1)) == "as") & (at(i + 2) == "(") | F.lower(at(i - 1)).isin("with", "recursive")
            return F.when(t.rlike(is_schema) & (after_as | operand(at(i - 1)) | cte), _folded(t))
        return F.array_compact(F.transform(bodies, own))

    def clause(c: Column, taken: Column) -> Column:
        def tokens(bodies: Column) -> Column:
            relations = F.lower(F.get(bodies, F.lit(0))).isin(*_RELATIONS)

            def one(t: Column, i: Column) -> Column:
                before = F.get(bodies, i - 1)
                relation = relations & ((i == 1) | (before == ","))
                first = _folded(F.regexp_extract(t, "^" + _NAME, 0))
                return F.when(t.rlike(head), renamed(t, relation | ~F.array_contains(taken, first))).otherwise(t)
            return F.transform(bodies, one)

        gaps = F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(1))
        bodies = F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(2))
        return F.array_join(F.zip_with(gaps, let(bodies, tokens), lambda g, t: F.concat(g, t)), "")

    def whole(t: Column) -> Column:
        bodies = F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(2))
        return let(let(bodies, declared), lambda taken: F.array_join(F.transform(_clauses(t), lambda c: clause(c, taken)), ""))

    return F.when(text.rlike(_maybe(names)), whole(text)).otherwise(text)


def qualify_sql_duckdb(text_sql: str, schemas: Iterable[str], catalog: str,
                       old_catalogs: Sequence[str] = (LEGACY_CATALOG,)) -> str:
    """A DuckDB expression (for the oracle) that gives the same for texts whose
    literals, comments and aliases hold no schema name before a dot.  A name may
    follow only a character that cannot be part of a longer or qualified name."""
    prefix = "(?:`?(?:" + alternation([*old_catalogs, catalog]) + ")`?\\x{2e})?"
    pattern = "(^|[^A-Za-z0-9_`.])" + prefix + "`?(" + alternation(schemas) + ")`?\\x{2e}"
    repl = "\\1" + re2_replacement(catalog) + ".\\2."
    return "regexp_replace({}, '{}', '{}', 'g')".format(text_sql, pattern.replace("'", "''"), repl.replace("'", "''"))


def qualify_sql(df: DataFrame, col: str, schemas: Iterable[str], catalog: str,
                old_catalogs: Sequence[str] = (LEGACY_CATALOG,), out: str | None = None) -> DataFrame:
    """V2 on a frame."""
    return df.withColumn(out or col, qualify_sql_col(F.col(col), schemas, catalog, old_catalogs))


def view_statement_col(catalog: str, schema: Column, view: Column, text: Column) -> Column:
    """P5: ``CREATE OR REPLACE VIEW `catalog`.`schema`.`view` AS text``."""
    name = F.concat_ws(".", quote_ident_col(F.lit(catalog)), quote_ident_col(schema), quote_ident_col(view))
    return F.concat(F.lit("CREATE OR REPLACE VIEW "), name, F.lit(" AS "), text)


def copy_statement_col(catalog: str, schema: Column, table: Column, source: Column, provider: Column,
                       location: Column, partitions: Column | None = None) -> Column:
    """P5: ``CREATE TABLE IF NOT EXISTS `catalog`.`schema`.`table` USING provider
    [PARTITIONED BY (...)] LOCATION '...' AS SELECT * FROM source``, the statement
    form of a copy."""
    name = F.concat_ws(".", quote_ident_col(F.lit(catalog)), quote_ident_col(schema), quote_ident_col(table))
    none = F.array().cast("array<string>")
    cols = F.transform(F.coalesce(partitions, none) if partitions is not None else none, quote_ident_col)
    layout = F.when(F.size(cols) > 0, F.concat(F.lit(" PARTITIONED BY ("), F.array_join(cols, ", "), F.lit(")"))).otherwise("")
    at = F.replace(F.replace(location, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), name, F.lit(" USING "), provider, layout,
                    F.lit(" LOCATION '"), at, F.lit("' AS SELECT * FROM "), source)


def view_statements(views: DataFrame, schemas: Iterable[str] | dict[str, str], catalog: str,
                    old_catalogs: Sequence[str] = (LEGACY_CATALOG,), target_schema: Column | None = None,
                    text_col: str = "view_text") -> DataFrame:
    """V3: (schema_name, view_name, view_stmt) with the text qualified."""
    text = qualify_sql_col(F.col(text_col), schemas, catalog, old_catalogs)
    schema = target_schema if target_schema is not None else F.col("schema_name")
    return views.select("schema_name", "view_name",
                        view_statement_col(catalog, schema, F.col("view_name"), text).alias("view_stmt"))


def relations_of(spark: SparkSession, stmt: str) -> tuple[tuple[str, str] | None, set[tuple[str, str]]]:
    """The (schema, name) that a statement creates and those of the relations that
    it reads, from the plan that Spark itself parses; names of one part are in the
    current schema."""
    def named(found: str) -> tuple[str, str]:
        parts = [p.strip().lower() for p in found.split(",")]
        return (parts[-2] if len(parts) > 1 else spark.catalog.currentDatabase().lower(), parts[-1])

    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(stmt).toString()
    except Exception:  # noqa: BLE001 - a text that does not parse names nothing; running it tells why
        return None, set()
    ctes = {c.strip().lower() for found in re.findall(r"CTE \[([^\]]*)\]", plan) for c in found.split(",")}
    made = re.search(r"UnresolvedIdentifier \[([^\]]*)\]", plan)
    reads = {named(found) for found in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan) if found.strip().lower() not in ctes}
    return (named(made.group(1)) if made else None), reads


def dependency_levels(spark: SparkSession, rows: Sequence[tuple[str, str, str]]) -> tuple[dict, dict]:
    """Of (schema, view, statement) rows: the level of every (schema, view), 1 for
    views that read no other of these views, and for views that read themselves
    through others the names of that cycle.  Views of a cycle share a level."""
    parsed = {(s, v): relations_of(spark, stmt) for s, v, stmt in rows}
    key = {made or (s.lower(), v.lower()): (s, v) for (s, v), (made, _) in parsed.items()}
    needs = {v: {key[r] for r in reads if r in key} - {v} for v, (_, reads) in parsed.items()}
    level: dict[tuple, int] = {}
    cycles: dict[tuple, str] = {}
    while len(level) < len(needs):
        ready = [v for v in needs if v not in level and needs[v] <= set(level)]
        if not ready:
            ready = _cycle({v: n - set(level) for v, n in needs.items() if v not in level})
            cycles |= dict.fromkeys(ready, ", ".join(f"{s}.{v}" for s, v in ready))
        here = {v: 1 + max((level[w] for w in needs[v] if w in level), default=0) for v in ready}
        level |= {v: max(here.values()) if v in cycles else n for v, n in here.items()}
    return level, cycles


def _cycle(needs: dict[tuple, set]) -> list[tuple]:
    """Of views that all wait: a smallest set that waits only for itself."""
    reach = {}
    for v in needs:
        seen, todo = set(), [v]
        while todo:
            new = needs[todo.pop()] - seen
            seen |= new
            todo += new
        reach[v] = seen
    return sorted(min(reach.values(), key=lambda group: (len(group), sorted(group))))


def cut_over_views(spark: SparkSession, stmts: DataFrame, max_rounds: int | None = None,
                   error_limit: int = 32000, max_workers: int = 8) -> DataFrame:
    """K5: run each view statement, views that others read first: the statements
    of one dependency level run side by side in a small pool.  Failed ones are
    retried while a round still makes progress; ``max_rounds`` caps the rounds.
    Outcome per view: schema_name, view_name, view_stmt, status (success/failed),
    error (P6: the first ``error_limit`` characters; a view of a cycle names the
    cycle).  Statements are catalog operations; the statement rows are streamed to
    the driver, not the data behind the views."""
    rows = [(r["schema_name"], r["view_name"], r["view_stmt"]) for r in
            stmts.select("schema_name", "view_name", "view_stmt").toLocalIterator()]
    level, cycles = dependency_levels(spark, rows)
    pending, done, errors, rounds = rows, [], {}, 0

    def create(row):
        try:
            spark.sql(row[2])
            return None
        except Exception as e:  # noqa: BLE001
            return str(e)

    while pending and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        failed = []
        for depth in sorted({level[r[:2]] for r in pending}):
            batch = [r for r in pending if level[r[:2]] == depth]
            with ThreadPoolExecutor(max_workers=max(1, min(max_workers, len(batch)))) as pool:
                for row, error in zip(batch, pool.map(create, batch)):
                    if error is None:
                        done.append((*row, "success", ""))
                    else:
                        errors[row[:2]] = (f"reads itself through {cycles[row[:2]]}: " if row[:2] in cycles else "") + error
                        failed.append(row)
        progress = len(failed) < len(pending)
        pending = failed
        if not progress:
            break
    done += [(*row, "failed", errors.get(row[:2], "")) for row in pending]
    out = records(spark, done, "schema_name string, view_name string, view_stmt string, status string, error string")
    return out.withColumn("error", bounded_text(F.col("error"), error_limit))
