"""Every report as a named query over the given tables, with the same result in plain SQL."""
