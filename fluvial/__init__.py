"""River hydraulics on Spark: cross-sections, rating tables, curves, flow statistics and rating-curve queries."""
