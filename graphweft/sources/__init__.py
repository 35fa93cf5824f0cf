"""Corpus scans, graph tables at rest, result output and table adapters."""
