"""Readers: files, page text, attribute tables, template definitions."""
