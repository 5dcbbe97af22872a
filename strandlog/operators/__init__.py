"""Filters, pages and folds over event logs."""
