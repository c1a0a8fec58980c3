"""Gleaner: structured extraction, matching and comparison of documents, as Spark DataFrame plans."""
