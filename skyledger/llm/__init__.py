"""Operators for text collections and free-entered values; nothing outside this subpackage imports it."""
