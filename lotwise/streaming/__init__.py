"""Streaming forms of the folds, with the results of the batch forms."""
