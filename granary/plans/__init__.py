"""Composite queries: compaction, collection, scrubbing, repair, and reads."""
