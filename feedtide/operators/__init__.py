"""DataFrame to DataFrame operators; each states its own partitioning."""
