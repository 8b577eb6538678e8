"""Whole jobs: relations over the test tables, the registered queries and the full reports."""
