"""Structured Streaming jobs over crawl results, metrics and health samples."""
