"""DuckDB statements the Spark queries are compared with."""
