"""Operators for preparing training text: ten large-scale jobs over documents, pages and vectors."""
