"""Review-explanation analytics as composable Spark DataFrame transforms."""
