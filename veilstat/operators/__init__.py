"""Relational and statistical operators as DataFrame plans."""
