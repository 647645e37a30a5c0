"""Operators that prepare text corpora, pages and embeddings for model training."""
