"""Registered queries over the supplied tables and their SQL twins."""
