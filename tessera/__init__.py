"""Tessera: Spark DataFrame operators for retrieval, rules, routing and evaluation analytics."""
