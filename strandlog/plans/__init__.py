"""Projections: event handlers compiled to DataFrame plans."""
