"""streaming of the traffic analytics engine."""
