"""Plan-level helpers: exact quantiles, grouped ranks, skew-safe joins, batch jobs."""
