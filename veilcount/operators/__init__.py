"""Operators over DataFrames; each works on all workspaces or cohorts at once."""
