"""A relational engine on Spark DataFrames: builder queries, catalog, planner, and training-data operators."""
