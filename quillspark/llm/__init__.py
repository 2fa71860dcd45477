"""Operators for building large training corpora. Nothing outside this subpackage imports it."""
