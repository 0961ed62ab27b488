"""Operators for building large text training sets. Nothing outside this subpackage imports it."""
