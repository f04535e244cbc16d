"""Structured Streaming forms: capacity ingestion (S4) and the daily-max stream."""
