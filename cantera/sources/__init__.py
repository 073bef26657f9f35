"""Readers, response parsers and sinks."""
