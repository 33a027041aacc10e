"""Session helpers and the query catalogue."""
