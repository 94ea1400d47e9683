"""DataFrame -> DataFrame operators (joins, dedup rounds, features, selection)."""
