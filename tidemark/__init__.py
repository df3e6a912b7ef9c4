"""Time-series table operators for Apache Spark."""
