"""Readers and writers of tables, stored pages and review blocks."""
