"""The queries: each takes a frame of cleaned readings and returns a frame."""
