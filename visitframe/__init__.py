"""Longitudinal analytics on Spark: visits, matching, profiling, validation."""
