"""Operators for text corpora; nothing else in the package depends on them."""
