"""Relational operators: selection, evidence, gates, assembly, state."""
