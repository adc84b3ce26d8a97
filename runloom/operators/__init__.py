"""DataFrame operators over episode tables."""
