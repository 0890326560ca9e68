"""Preparing text for training language models: ten operators, their queries and SQL.

Nothing else in the library imports this package.
"""
