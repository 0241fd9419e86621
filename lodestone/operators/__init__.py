"""Dataflow operators: chunking, indexing, candidates, fusion, presentation, maintenance."""
