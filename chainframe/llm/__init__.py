"""Operators for preparing large text corpora."""
