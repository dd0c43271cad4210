"""Relational operators: bodies of rules, grouping, coalescing of intervals."""
