"""Column-level building blocks: text, hashing, statistics."""
