"""Structured Streaming: sessions, retractions, late rows, locks, caches and run logs."""
