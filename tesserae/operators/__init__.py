"""Relational, graph, ranking and text operators of the knowledge graph."""
