"""Operators for building training corpora; each module documents its method.

Nothing else in the library imports this subpackage.
"""
