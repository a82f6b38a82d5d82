"""Operators for building language-model training data, and their queries.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
