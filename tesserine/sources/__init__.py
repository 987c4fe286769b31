"""Readers and writers of the text formats and of tables."""
