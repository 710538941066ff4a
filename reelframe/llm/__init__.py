"""Operators over text and page corpora, their queries and SQL texts."""
