"""Spark jobs for metered power time series."""
