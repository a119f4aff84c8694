"""Operators for preparing text corpora at scale.

Nothing outside this subpackage imports it; deleting the folder leaves the
analytics engine intact.
"""
