"""Example domains."""
