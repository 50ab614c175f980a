"""Per-tenant term dictionaries and top-K suggestion queries on Spark DataFrames."""
