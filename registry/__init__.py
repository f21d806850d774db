"""The registered queries: each runs on Spark and, where SQL can say it, has
an equivalent DuckDB text."""
