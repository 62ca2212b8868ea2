"""Indexing as a stream of file arrivals."""
