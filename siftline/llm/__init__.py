"""Operators that prepare training data: near-duplicates, mixing, language, secrets, leaks and quality."""
