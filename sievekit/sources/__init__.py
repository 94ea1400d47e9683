"""Readers and writers: driver tables, corpus adapters, JSON corpus, curation lists."""
