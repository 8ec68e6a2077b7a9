"""Relational operators that Spark has no single plan node for."""
