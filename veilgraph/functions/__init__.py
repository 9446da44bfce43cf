"""Canonical JSON, keyed draws, dates, exact quantities, and the typed walk."""
