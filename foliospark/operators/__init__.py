"""Operators over DataFrames: cases, matching, reconciliation, staging, review, reports."""
