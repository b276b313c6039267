"""Scalar functions: keyed randomness, noise, special functions."""
