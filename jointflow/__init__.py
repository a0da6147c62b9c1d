"""jointflow: pose-stream analytics as Spark DataFrame operators."""
