"""Operators on text and code collections for training data; nothing outside this subpackage imports it."""
