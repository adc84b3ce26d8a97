"""Whole cycles composed from the operators."""
