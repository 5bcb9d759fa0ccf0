"""Operators for building text training corpora.

Nothing else in the package imports this subpackage.
"""
