"""Post-loan collections analytics expressed as Spark DataFrame jobs."""
