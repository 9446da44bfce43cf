"""Spark-native record linkage, keyed perturbation and validation of clinical documents."""

__version__ = "0.1.0"
