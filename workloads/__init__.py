"""Queries over the benchmark tables and their independent SQL oracles."""
