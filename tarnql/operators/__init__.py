"""The operators of a plan: scan, select, project, union, join, group by and sort."""
