"""Tables that grow with a stream of events."""
