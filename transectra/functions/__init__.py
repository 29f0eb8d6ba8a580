"""Column-to-Column scalars and distributed numeric helpers."""
