"""Column builders: text profiles, shingles, hashes, structural counters."""
