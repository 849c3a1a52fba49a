"""Column builders: pure expressions that stay in the JVM."""
