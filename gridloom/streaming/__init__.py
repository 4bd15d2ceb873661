"""State carried from batch to batch."""
