"""Readers of raw logs and driver tables, and writers of result tables."""
