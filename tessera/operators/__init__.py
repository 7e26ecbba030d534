"""Operators of tessera."""
