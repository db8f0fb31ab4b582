"""Streams: progress, conversations, token deltas, pushes."""
