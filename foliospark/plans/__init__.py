"""Whole plans: rule-based extraction of forms, the document pipeline, the batch over an inbox."""
