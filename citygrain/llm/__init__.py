"""Operators over texts for training data: packing, mixing and quality statistics."""
