"""Relational operators over documents, pages and words."""
