"""Operators for preparing text corpora for language-model training.

Nothing outside this folder imports it: the rest of the library works without it.
"""
