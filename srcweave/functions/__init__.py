"""Column functions: ids, paths, severities and text predicates."""
