"""Sequences of stages: configuration, running, book-keeping."""
