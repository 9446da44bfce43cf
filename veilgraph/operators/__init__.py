"""Relational and per-document operators of the core engine."""
