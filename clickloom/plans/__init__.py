"""Whole jobs composed from the operators, and the logical views over the provided tables."""
