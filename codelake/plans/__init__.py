"""The query catalogue, by kind."""
