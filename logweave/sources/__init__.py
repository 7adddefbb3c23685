"""Readers, event catalogues, chunk plans and file sinks."""
