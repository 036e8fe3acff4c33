"""Relational, ordered and statistical building blocks."""
