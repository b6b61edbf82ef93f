"""Operators for building training data: archives, quality, secrets, mixing, packing, near copies, scoring, chat."""
