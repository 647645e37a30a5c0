"""Operators over the relations of a file collection: files, file_chunks, blocks, dedup, audit, users."""
