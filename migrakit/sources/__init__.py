"""Sources: table references, scans, counts, record frames, documents."""
