"""Operators for training-data pipelines, each with one registered query. Nothing else in the library imports them."""
