"""Operators for preparing language-model training data at scale.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface, and the thin ``opN_<name>`` query that
applies it to a whole table; ``queries.py`` collects the queries.
"""
