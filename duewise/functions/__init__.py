"""Column expressions: rates, dates, buckets, text."""
