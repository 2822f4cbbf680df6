"""Granary: a PySpark engine over archive catalogs and text corpora."""
