"""Scoring reviews as they arrive."""
