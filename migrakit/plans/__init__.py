"""Named plans over the test tables, with their DuckDB oracle statements."""

from .registry import ORACLE, PLANS


def load_all():
    """Import every plan module so that all plans are registered."""
    from . import copy_check, doc_plans, grant_plans, stream_plans, sync_plans, view_plans, whole_doc_plans  # noqa: F401
    return PLANS, ORACLE
