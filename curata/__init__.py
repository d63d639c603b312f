"""Curation and evaluation of labelled collections on PySpark."""
