"""Operators that prepare text for training: packing, mixing and shared passages."""
