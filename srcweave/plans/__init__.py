"""Whole analyses, and the binding of every operator to the supplied tables."""
