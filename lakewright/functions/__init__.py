"""Parsers that run as Arrow-batched table functions."""
