"""Table readers and writers, and the mapping of star-schema tables to the collections model."""
