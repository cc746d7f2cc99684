"""Readers, writers and the folders that jobs share."""
