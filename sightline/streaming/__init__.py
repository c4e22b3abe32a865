"""Structured Streaming forms of the panel's inputs; each runs on a batch table as well."""
