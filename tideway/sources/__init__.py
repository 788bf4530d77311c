"""sources of the traffic analytics engine."""
