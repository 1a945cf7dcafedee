"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage. Each module holds one
operator with a general interface; ``queries`` holds the registered queries.
"""
