"""Lamina: a document-analytics engine expressed on PySpark DataFrames."""
