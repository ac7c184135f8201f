"""The stages of a sequence, each a transformation of the events' frame, some with a result table."""
