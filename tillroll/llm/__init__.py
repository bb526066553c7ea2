"""Operators for large text corpora (quality, near duplicates, language, tokens,
search, secrets, packing).  Nothing outside this subpackage imports it."""
