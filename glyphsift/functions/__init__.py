"""Scalar functions: keys, tokens, sequences, distance."""
