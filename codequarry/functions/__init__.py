"""Column functions: pure expressions, evaluated inside the JVM unless said otherwise."""
