"""Whole workflows over the operators."""
