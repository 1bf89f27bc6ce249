"""Continuous forms: micro-batch publication, deduplication, windows and keyed state."""
