"""Power endpoints from a stream of events."""
