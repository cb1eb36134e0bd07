"""Operators on text corpora and learned groupings; nothing outside imports this."""
