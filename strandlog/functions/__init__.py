"""Scalar functions on events."""
