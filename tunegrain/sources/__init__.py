"""Readers, writers and table compaction."""
