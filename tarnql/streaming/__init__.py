"""Relations that grow: builder queries over streams, and streams appended to relations.

Spark brings this along; it goes beyond relations at rest, and adds no operators of its own.
"""
