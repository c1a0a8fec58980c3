"""Whole plans: extraction of papers, comparison of tables, topics and ranks of documents."""
