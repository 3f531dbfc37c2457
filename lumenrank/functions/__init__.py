"""Column builders: analysis, statistics, formulas, templates, normalisation."""
