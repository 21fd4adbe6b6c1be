"""Functions of spanloom."""
