"""Structured Streaming sources and keyed running features."""
