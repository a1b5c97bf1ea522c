"""Readers and writers of text, tree, localisation, stats and archive formats."""
