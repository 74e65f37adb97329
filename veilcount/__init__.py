"""Consent-aware product analytics as Spark DataFrame and streaming jobs."""
