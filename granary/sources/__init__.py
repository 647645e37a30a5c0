"""Readers of containers, manifests and metrics, and the options of a collection."""
