"""Corpus loaders and result sinks."""
