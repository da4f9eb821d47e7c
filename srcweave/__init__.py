"""Code-corpus analytics on Spark DataFrames.

Many source trees are read as one table of files; declarations, imports,
calls and assignments are extracted by a distributed job and everything
after that is joins, groupings and column expressions keyed by project.
"""

__version__ = "0.1.0"
