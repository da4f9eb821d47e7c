"""Operators for preparing training data at scale, and the pipeline stages built on them."""
