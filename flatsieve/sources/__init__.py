"""Readers of flat files and tables."""
