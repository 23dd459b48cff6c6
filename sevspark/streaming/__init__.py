"""Structured Streaming jobs; transformations are the batch operators wherever the engine allows it."""
