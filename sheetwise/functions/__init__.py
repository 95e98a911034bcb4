"""Values, coercions and the function library, as Spark columns."""
