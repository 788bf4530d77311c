"""functions of the traffic analytics engine."""
