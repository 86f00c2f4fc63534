"""Operators for preparing text as training data. Nothing outside this subpackage imports it."""
