"""Structured Streaming forms of the blending operator."""
