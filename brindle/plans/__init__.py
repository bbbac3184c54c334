"""Query builders that compile to one DataFrame plan."""
