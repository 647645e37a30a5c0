"""Content-addressed file collections as Spark DataFrames: chunks, catalog, maintenance plans and reads."""
