"""Registry, discovery and the query catalogue."""
