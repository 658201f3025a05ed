"""tessel: PostgreSQL-style analytics recipes expressed on Spark's DataFrame and SQL API."""
