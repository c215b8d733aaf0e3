"""Buy-side analytics as composable Spark DataFrame operators."""
