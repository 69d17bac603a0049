"""Relations and their files: the database, text sources and read workloads."""
