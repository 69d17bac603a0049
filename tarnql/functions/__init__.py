"""Types, row expressions and fold aggregates, and how they become Spark columns."""
