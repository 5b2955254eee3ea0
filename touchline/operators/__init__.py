"""DataFrame operators: histories, features, metrics, upserts, expectations."""
