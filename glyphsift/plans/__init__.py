"""Boolean queries: their language, and what they compile to."""
