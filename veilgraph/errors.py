"""Errors that may be shown: they never quote source data."""


class InputError(ValueError):
    """Inputs or settings are wrong, in words that are safe to display."""


class PerturbationError(InputError):
    """Perturbation or its validation failed."""
