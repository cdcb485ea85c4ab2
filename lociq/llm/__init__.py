"""Operators for training data: near-duplicates, shared spans, item pairs, tokens, packing, garbled text.

Nothing outside this subpackage imports it.
"""
