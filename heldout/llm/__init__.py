"""Operators for preparing training data: filters, scans, deduplication, decontamination, archives, tokens."""
