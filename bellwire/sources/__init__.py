"""Readers and writers for headlines, prices, lexicons and plain tables."""
