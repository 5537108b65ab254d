"""Types, casts and scalar functions as Spark SQL text."""
