"""migrakit: table migration operators for PySpark.

Plan which tables to copy, copy them, check every copy, plan a schema sync,
qualify names in view texts, translate access grants and rewrite nested
configuration documents -- each as DataFrame in, DataFrame out."""

__version__ = "0.1.0"

from .operators.copying import copy_from_plan, copy_table, copy_tables, needs_copy, plan_copy, with_target_path
from .operators.documents import (ClusterParams, JobParams, acl_by_object, each, edit_json, filter_ids, flatten_acl, parse_docs,
                                  promote, read_doc_files,
                                  read_docs, rebase_init_scripts, rebase_jars, remap_ids, rewrite_cluster,
                                  rewrite_job, rewrite_job_cluster, rewrite_policy_definition, set_pause,
                                  tag_principal)
from .operators.grants import (dedup_grants, grant_changes, grants_by_principal, tables_by_schema, tables_of,
                               translate_privileges, with_usage)
from .operators.merge import outer_match
from .operators.projections import attributes_wide, explode_list, stringify, with_list_size
from .operators.sqltext import cut_over_views, qualify_sql, view_statements
from .operators.sync import apply_sync, plan_sync, sync_report, views_of
from .operators.verify import join_results, split_outcomes, verify_copies, verify_counts
from .operators.whole_docs import (promote_doc, rewrite_cluster_doc, rewrite_docs, rewrite_job_doc, rewrite_library_doc,
                                   rewrite_new_cluster)
from .session import build_session, shared_root, work_dir
from .sources.catalog import describe_long, inventory_from_catalog, list_tables
from .sources.tables import TableRef, count_tables, read_table, records, union_all
from .streaming.resumable_copy import copy_resumable

__all__ = [
    "ClusterParams", "JobParams", "TableRef", "apply_sync", "attributes_wide", "build_session", "copy_from_plan",
    "copy_resumable", "copy_table", "copy_tables", "count_tables", "cut_over_views", "dedup_grants",
    "describe_long", "each", "edit_json", "explode_list", "filter_ids", "flatten_acl", "grant_changes",
    "grants_by_principal", "acl_by_object", "inventory_from_catalog", "join_results", "parse_docs", "promote_doc", "rewrite_cluster_doc",
    "rewrite_docs", "rewrite_job_doc", "rewrite_library_doc", "rewrite_new_cluster", "list_tables", "needs_copy", "outer_match", "plan_copy",
    "plan_sync", "promote", "qualify_sql", "read_doc_files", "read_docs", "read_table", "rebase_init_scripts",
    "rebase_jars", "records", "remap_ids", "rewrite_cluster", "rewrite_job", "rewrite_job_cluster",
    "rewrite_policy_definition", "set_pause", "shared_root", "split_outcomes", "stringify", "sync_report",
    "tables_by_schema", "tables_of", "tag_principal", "translate_privileges", "union_all", "verify_copies",
    "verify_counts", "view_statements", "views_of", "with_list_size", "with_target_path", "with_usage",
    "work_dir",
]
