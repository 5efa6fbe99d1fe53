"""Relational, graph and optimisation operators."""
