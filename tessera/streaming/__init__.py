"""Streaming of tessera."""
