"""Expressions and per-event reductions as Spark columns."""
