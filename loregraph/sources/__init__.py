"""Readers and writers: transcripts, git tables, the graph store, import/export."""
