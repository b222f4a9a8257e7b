"""From query text to clauses."""
