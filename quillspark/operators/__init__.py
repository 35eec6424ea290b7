"""Relational building blocks: text, lines, vectors, scoring, matching."""
