"""Operators that prepare text and vectors for language models; nothing outside imports this package."""
