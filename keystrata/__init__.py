"""Ordered key-value data on Spark: an append-only log of puts and deletes, resolved, stored in sorted runs, merged."""
