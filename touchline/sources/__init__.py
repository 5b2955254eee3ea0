"""Readers and writers: source tables, provider payloads, datasets, run tables."""
