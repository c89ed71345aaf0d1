"""Runs as streams: what is nothing but a fold in order, kept in state as its parts arrive."""
