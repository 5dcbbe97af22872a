"""Subscriptions and incremental folds on Structured Streaming."""
