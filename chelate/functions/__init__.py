"""Column functions: SQL expressions that stay in the JVM."""
