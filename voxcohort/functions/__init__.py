"""Column functions; everything here is a native Spark expression."""
