"""Whole stages composed from the operators, and the query catalogue."""
