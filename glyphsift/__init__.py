"""Approximate search over token sequences, declared as Spark plans."""
