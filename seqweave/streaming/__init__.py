"""Query reads that arrive as a stream."""
