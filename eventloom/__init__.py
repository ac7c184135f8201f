"""Eventloom: declarative reduction of nested event data on Spark."""
