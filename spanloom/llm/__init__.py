"""Operators for text that is prepared for training language models. Nothing outside imports this subpackage."""
