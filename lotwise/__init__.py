"""Listing analytics on Spark: extract, clean, keep, search and link auction listings."""
