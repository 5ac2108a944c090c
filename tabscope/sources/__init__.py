"""Reading, writing and identifying stored tables."""
