"""Incremental runs as streams that end when all there is has been read."""
