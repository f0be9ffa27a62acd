"""Operators for building training data from text corpora. Nothing outside this subpackage imports it."""
