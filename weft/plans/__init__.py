"""Execution helpers shared by the operators."""
