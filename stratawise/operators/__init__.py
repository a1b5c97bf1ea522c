"""Relational operators: precedence, lookup, diff, integrity, staging."""
