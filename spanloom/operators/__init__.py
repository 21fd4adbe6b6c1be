"""Operators of spanloom."""
