"""Sources of tessera."""
