"""Relational operators: features, markers, graphs, assignment, merging."""
