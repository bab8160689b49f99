"""Operators for training data of language models: percentiles, runs, leaks, mixtures, cut texts."""
