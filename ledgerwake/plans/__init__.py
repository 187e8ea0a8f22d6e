"""Whole jobs made of the operators, and their results."""
