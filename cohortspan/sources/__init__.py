"""Readers, writers, the specialty lookup and the mapping of the test tables."""
