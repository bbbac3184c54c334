"""A document collection engine on Spark: queries, relations, commits, change logs and live views."""
