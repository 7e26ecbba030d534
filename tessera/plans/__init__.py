"""Registered queries: each module binds operators to the given tables."""

from tessera.plans import dataset, evaluation, faithfulness, files, kg, retrieval, robustness, routing

FLAGSHIP = retrieval.extractive_answer

__all__ = ["FLAGSHIP", "dataset", "evaluation", "faithfulness", "files", "kg", "retrieval", "robustness", "routing"]
