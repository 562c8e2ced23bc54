"""Independent SQL text used to check the Spark queries."""
