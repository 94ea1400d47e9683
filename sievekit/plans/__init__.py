"""End-to-end flows (dedup stage, selection stage, curation) and the query catalogue."""
