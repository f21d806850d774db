"""Network-traffic analytics expressed as Spark DataFrame jobs."""
