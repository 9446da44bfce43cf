"""Operators for preparing text corpora at scale; nothing outside this subpackage imports it."""
