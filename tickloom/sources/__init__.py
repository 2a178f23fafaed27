"""Readers, generators, seeds and sinks."""
