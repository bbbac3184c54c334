"""Values, predicates and orders as Spark columns."""
