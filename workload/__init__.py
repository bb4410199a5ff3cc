"""Queries of the library over the given tables, with their SQL counterparts."""
