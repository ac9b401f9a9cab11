"""Audited, reproducible machine-learning datasets from several catalogues of the same objects."""
