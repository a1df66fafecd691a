"""Operators for large training corpora.

Every module holds one operator with a general interface; ``queries`` holds the thin registered queries.
Nothing outside this subpackage imports it.
"""
