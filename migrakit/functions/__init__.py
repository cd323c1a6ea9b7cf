"""Column-expression helpers (strings, versions, maps, regex, JSON)."""
