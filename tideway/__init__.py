"""Road-traffic analytics as composable Spark DataFrame transformations."""
