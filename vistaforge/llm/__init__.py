"""Operators that prepare collections of images and texts for training models. Nothing outside imports this package."""
