"""Structured Streaming: multi-source merge, progress, replay and monitors."""
