"""Compositions of operators: ingest, retrieval and reports."""
