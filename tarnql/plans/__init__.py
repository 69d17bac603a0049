"""Plans, the fluent builder, and the join-order planners above Catalyst."""
