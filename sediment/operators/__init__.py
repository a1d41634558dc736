"""Relational operators over catalogs, snapshots and journals."""
