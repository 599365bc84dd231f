"""Relational operators on objects, relations, documents and knowledge-graph tables."""
