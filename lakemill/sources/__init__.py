"""CSV, generated and demo tables."""
