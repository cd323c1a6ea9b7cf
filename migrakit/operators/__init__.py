"""DataFrame operators: copy, verify, sync, SQL text, grants, documents."""
