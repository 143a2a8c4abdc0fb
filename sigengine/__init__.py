"""Disproportionality and signal analysis on Spark."""
