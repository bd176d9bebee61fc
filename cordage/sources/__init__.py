"""Readers and writers: record files, append-only logs and versioned tables."""
