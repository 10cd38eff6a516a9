"""Operators for large text corpora and record consolidation; nothing else imports this package."""
