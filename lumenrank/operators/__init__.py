"""Relevance operators, models, ranking, logging and metrics."""
