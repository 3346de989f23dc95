"""Operators for preparing text corpora: filtering, matching, tokenising, scoring and formatting.

Nothing else in the library imports this subpackage.
"""
