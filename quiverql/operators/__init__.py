"""Clauses as DataFrame operations."""
