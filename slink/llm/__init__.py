"""Operators over training documents: filtering, deduplication, redaction, mixing, encoding and search."""
