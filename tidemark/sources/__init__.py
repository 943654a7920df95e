"""Generators, readers and adapters of tables."""
