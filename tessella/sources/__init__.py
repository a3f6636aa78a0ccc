"""Readers, writers and the corpus generator."""
