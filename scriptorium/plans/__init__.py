"""Pipelines made of operators, and the registered queries."""
