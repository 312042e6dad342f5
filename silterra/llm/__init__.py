"""Operators that prepare training text for language models; nothing outside this package imports it."""
