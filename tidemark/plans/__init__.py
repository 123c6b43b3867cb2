"""Whole analyses composed of operators: tests, experiments, quality gates."""
