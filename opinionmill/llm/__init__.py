"""Operators that prepare training data for language models, each by one named method."""
