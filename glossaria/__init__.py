"""Localisation-catalogue analytics on PySpark: scan, extract, validate, join, merge, report, stream."""
