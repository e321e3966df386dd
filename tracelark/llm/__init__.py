"""Operators for preparing training text: scans, scores, extraction and deduplication over whole tables."""
