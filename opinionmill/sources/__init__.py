"""Readers and writers for reviews, lexicons, tables, models and metrics."""
