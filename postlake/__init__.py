"""Postlake: analytics over large collections of text-rich postings, as Spark DataFrame plans."""
