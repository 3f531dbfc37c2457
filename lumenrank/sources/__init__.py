"""Corpora, judgments, training files and the element store."""
