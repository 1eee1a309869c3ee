"""Predicates, orders, statements and fragments as immutable plans."""
