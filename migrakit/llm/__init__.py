"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries.py``
applies them to whole tables and registers the results.
"""
