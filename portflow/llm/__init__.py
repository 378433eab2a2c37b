"""Operators for large training-data pipelines (text, pages, vectors). Nothing else in the library imports this subpackage."""
