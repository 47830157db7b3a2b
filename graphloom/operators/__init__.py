"""Relational operators: matching, metrics, search, ontology, graph, resolution, chunking, spans."""
