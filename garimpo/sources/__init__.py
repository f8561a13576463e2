"""Catalogue, raw documents and sinks."""
