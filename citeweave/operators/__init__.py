"""Relational operators, each DataFrame in, DataFrame out."""
