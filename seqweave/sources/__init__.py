"""Where reads and results come from."""
