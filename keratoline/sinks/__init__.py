"""Writers of raw, compact and detailed tables, source lists and rejects."""
