"""Whole configuration documents rewritten with every other key kept.

A document is a map from key to VARIANT, so a rule replaces or removes the keys
that it names and all others -- known or not, at any depth -- pass through with
their JSON types.  Same rules as ``documents``; this form returns complete
documents as JSON text (keys in sorted order, the canonical form of a variant).
Per-row JVM expressions in one narrow stage.

Every nested object is parsed once and bound (``let``); rules read the bound
value.  Text that is not a JSON object, or holds a key twice at any depth, is set
aside as it is, never replaced.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maps import repeats_keys
from ..functions.parallel import let, parse_json
from ..functions.strings import basename, is_blank, join_path
from ..functions.versions import floor_version
from .documents import (DEFAULT_CATALOG_KEY, EBS_FIELDS, LEGACY_CONF_KEYS, SINGLE_USER, ClusterParams, JobParams,
                        security_mode, single_user, with_suffix)

DOC = "map<string,variant>"


# ------------------------------------------------------------ map and variant

def get(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def has(m: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(m, key), F.lit(False))


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def as_object(v: Column) -> Column:
    """The keys of a JSON object; NULL for any other value."""
    return F.try_variant_get(v, "$", DOC)


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def to_variant(c: Column) -> Column:
    """A map or array of variants as one variant."""
    return F.to_variant_object(c)


def put(m: Column, values: dict[str, Column]) -> Column:
    """``m`` with keys set to variants; a NULL removes the key."""
    names = list(values)
    new = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values.values())), lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(m, lambda k, v: ~k.isin(names)), new)


def each_object(v: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` on every object of a list; other elements, and a value that is no
    list, stay as they are."""
    def one(e: Column) -> Column:
        return let(as_object(e), lambda o: F.when(o.isNull(), e).otherwise(to_variant(rule(o))))

    return F.coalesce(to_variant(F.transform(as_list(v), one)), v)


def _string(c: Column) -> Column:
    return c.cast("variant")


# ------------------------------------------------------------ rules

def _conf(m: Column, drop: Sequence[str], catalog: str | None = None) -> Column:
    """``spark_conf`` without ``drop`` and, where a catalog is given, with it."""
    kept = F.map_filter(as_object(get(m, "spark_conf")), lambda k, v: ~k.isin(list(drop)))
    if is_blank(catalog):
        return F.coalesce(to_variant(kept), get(m, "spark_conf"))
    empty = F.create_map().cast(DOC)
    return let(F.coalesce(kept, empty), lambda c: to_variant(put(c, {DEFAULT_CATALOG_KEY: _string(F.lit(catalog))})))


def _disk(m: Column) -> Column:
    def sized(aws: Column) -> Column:
        out = F.lit(False)
        for f in EBS_FIELDS:
            out = out | has(aws, f)
        return out

    return F.when(~let(as_object(get(m, "aws_attributes")), sized), get(m, "disk_spec"))


def _version(m: Column) -> Column:
    """The floored version where it is a string, else the value as it is."""
    return F.coalesce(let(as_text(get(m, "spark_version")), lambda v: _string(floor_version(v))), get(m, "spark_version"))


def _scripts(v: Column, base: str) -> Column:
    """Workspace scripts move to ``base``; volumes and s3 scripts keep their
    destination; other kinds go."""
    at = lambda o, k: as_text(get(as_object(get(o, k)), "destination"))
    pack = lambda k, d: F.create_map(F.lit(k), F.create_map(F.lit("destination"), d))

    def one(o: Column) -> Column:
        return (F.when(has(o, "workspace"), let(at(o, "workspace"), lambda d: pack("volumes", join_path(base, basename(d)))))
                .when(has(o, "volumes"), pack("volumes", at(o, "volumes"))).when(has(o, "s3"), pack("s3", at(o, "s3"))))

    moved = F.filter(F.transform(as_list(v), lambda e: let(as_object(e), one)), lambda x: x.isNotNull())
    return F.coalesce(F.to_variant_object(moved), v)


def rewrite_cluster_doc(m: Column, p: ClusterParams) -> Column:
    """All cluster rules (D1, D3-D6, D9, D10) on one cluster document."""
    policy = get(m, "policy_id") if is_blank(p.policy_id) else F.when(has(m, "policy_id"), _string(F.lit(p.policy_id)))

    def ruled(version: Column, user: Column) -> Column:
        named = user.isNotNull() | has(m, "single_user_name")
        values = {
            "spark_version": F.coalesce(_string(version), get(m, "spark_version")),
            "single_user_name": F.coalesce(_string(user), get(m, "single_user_name")),
            "data_security_mode": _string(security_mode(version, as_text(get(m, "data_security_mode")))),
            "init_scripts": F.when(named, get(m, "init_scripts")).otherwise(_scripts(get(m, "init_scripts"), p.volume_path)),
            "spark_conf": _conf(m, p.drop_conf_keys),
            "disk_spec": _disk(m),
            "policy_id": policy,
        }
        for f in ("cluster_name", "name"):
            values[f] = F.coalesce(let(as_text(get(m, f)), lambda n: _string(with_suffix(n, p.suffix))), get(m, f))
        return put(m, values)

    def floored(version: Column) -> Column:
        return let(single_user(version, as_text(get(m, "single_user_name")), p.single_user), lambda user: ruled(version, user))

    return let(as_text(get(m, "spark_version")), lambda v: let(floor_version(v), floored))


def rewrite_new_cluster(m: Column, catalog: str | None, drop: Sequence[str] = LEGACY_CONF_KEYS) -> Column:
    """The rules on the ``new_cluster`` object of a job cluster or task."""
    return put(m, {"spark_version": _version(m), "data_security_mode": _string(F.lit(SINGLE_USER)),
                   "spark_conf": _conf(m, drop, catalog), "disk_spec": _disk(m)})


def _pause(v: Column, status: str | None) -> Column:
    if status not in ("PAUSED", "UNPAUSED"):
        return v
    return let(as_object(v), lambda o: F.when(has(o, "pause_status"), to_variant(put(o, {"pause_status": _string(F.lit(status))})))
               .otherwise(v))


def _run_as(m: Column, name: str | None) -> Column:
    who = as_text(get(m, "run_as_user_name"))
    if not is_blank(name):
        who = F.when(who.isNotNull(), F.lit(name))

    def tagged(w: Column) -> Column:
        kind = F.when(w.contains("@"), F.lit("user_name")).otherwise(F.lit("service_principal_name"))
        return F.to_variant_object(F.when(w.isNotNull(), F.create_map(kind, w)))

    return F.coalesce(let(who, tagged), get(m, "run_as"))


def promote_doc(m: Column, key: str) -> Column:
    """The keys of object ``key`` become top-level keys; the nested value wins."""
    def merged(inner: Column) -> Column:
        outer = F.map_filter(m, lambda k, v: (k != key) & ~F.coalesce(F.map_contains_key(inner, k), F.lit(False)))
        return F.when(inner.isNull(), m).otherwise(F.map_concat(outer, inner))

    return let(as_object(get(m, key)), merged)


def rewrite_job_doc(m: Column, p: JobParams) -> Column:
    """All job rules (D7-D11, D14) on one job document; ``settings`` are promoted."""
    def element(e: Column) -> Column:
        cluster = let(as_object(get(e, "new_cluster")), lambda c: F.when(c.isNotNull(), to_variant(rewrite_new_cluster(c, p.catalog))))
        attached = get(e, "existing_cluster_id")
        if not is_blank(p.existing_cluster_id):
            attached = F.when(has(e, "existing_cluster_id"), _string(F.lit(p.existing_cluster_id)))
        return put(e, {"new_cluster": F.coalesce(cluster, get(e, "new_cluster")), "existing_cluster_id": attached})

    def ruled(m: Column) -> Column:
        return put(m, {
            "name": F.coalesce(let(as_text(get(m, "name")), lambda n: _string(with_suffix(n, p.suffix))), get(m, "name")),
            "schedule": _pause(get(m, "schedule"), p.pause_status), "continuous": _pause(get(m, "continuous"), p.pause_status),
            "run_as": _run_as(m, p.run_as),
            "job_clusters": each_object(get(m, "job_clusters"), element), "tasks": each_object(get(m, "tasks"), element)})

    return let(promote_doc(m, "settings"), ruled)


def rewrite_library_doc(m: Column, base: str) -> Column:
    """D5 on a cluster's library answer: ``libraries`` lists the library objects
    whole, jars moved to ``base``; statuses without a library go."""
    def moved(lib: Column) -> Column:
        jar = let(as_text(get(lib, "jar")), lambda j: _string(join_path(base, basename(j))))
        return F.when(has(lib, "jar"), to_variant(put(lib, {"jar": jar})))

    def one(status: Column) -> Column:
        return let(get(as_object(status), "library"), lambda lib: F.coalesce(let(as_object(lib), moved), lib))

    libs = F.filter(F.transform(as_list(get(m, "library_statuses")), one), lambda x: x.isNotNull())
    return put(m, {"libraries": F.to_variant_object(libs), "library_statuses": F.lit(None).cast("variant")})


def rewrite_docs(df: DataFrame, col: str, rule: Callable[[Column], Column], bad: str = "bad_doc") -> DataFrame:
    """``df`` with the documents in ``col`` rewritten and, in ``bad``, the text of those
    that are no JSON object or hold a key twice (then ``col`` is NULL)."""
    keep = tuple(c for c in df.columns if c != col)
    parsed = parse_json(df, col, DOC, "_doc", keep=tuple(df.columns))
    broken = F.col("_doc").isNull() | F.coalesce(repeats_keys(F.col("_doc")), F.lit(False))
    # The rewritten map is worked out once, behind a generator, then written.
    new = F.when(~broken, rule(F.col("_doc")))
    done = parsed.select(*keep, col, broken.alias("_broken"), F.explode(F.array(new)).alias("_new"))
    return done.select(*keep, F.to_json(F.to_variant_object("_new")).alias(col),
                       F.when(F.col("_broken"), F.col(col)).alias(bad))
