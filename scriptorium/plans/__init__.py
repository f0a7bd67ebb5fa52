"""Whole pipelines: the digest of a collection, its documents and its report."""
