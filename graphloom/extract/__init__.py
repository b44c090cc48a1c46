"""Extractors: source text to matches, one row for each construct of a program."""
