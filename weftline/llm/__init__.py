"""Operators for corpora of text; nothing outside this subpackage imports it."""
