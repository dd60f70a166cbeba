"""Reusable dataset operators: skew-safe joins, numbering, quantiles, facets, bins, samples."""
