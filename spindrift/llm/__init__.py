"""Operators for large text collections; nothing outside this folder imports it."""
