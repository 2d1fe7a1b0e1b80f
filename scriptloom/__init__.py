"""Spark jobs over large collections of timed speech transcripts."""
