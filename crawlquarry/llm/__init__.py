"""Operators that prepare crawled text as training data. Nothing outside this package imports it."""
