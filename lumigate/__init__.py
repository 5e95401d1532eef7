"""Embedding moderation, review and decision jobs for Spark."""
