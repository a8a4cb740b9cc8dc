"""Readers, writers and views over the benchmark tables."""
