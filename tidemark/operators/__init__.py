"""DataFrame operators, from raw measurements to per-series metrics."""
