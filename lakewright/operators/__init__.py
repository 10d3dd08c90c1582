"""Operators as relations and verified queries over them."""
