"""Sequence diagnostics for PySpark: episode tables, hidden-state models, audits."""

__version__ = "0.1.0"
