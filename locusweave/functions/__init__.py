"""Column functions: expressions that stay in the JVM, and Arrow functions for what Spark SQL lacks."""
