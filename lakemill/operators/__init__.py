"""The registered queries, one per operator."""
