"""Schemas, readers, sinks and the views over the sample tables."""
