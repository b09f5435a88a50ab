"""Operators for training data: sampling, overlaps, neighbours, cutoffs, tokens and text quality."""
