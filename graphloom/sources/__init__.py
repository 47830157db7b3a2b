"""Readers and writers of annotation, prediction, ontology and token files."""
