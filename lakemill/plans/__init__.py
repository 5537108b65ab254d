"""Lexer, parser, syntax tree and binder: SQL text to Spark SQL."""
