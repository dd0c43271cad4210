"""From program text to clauses."""
