"""Streaming monitors."""
