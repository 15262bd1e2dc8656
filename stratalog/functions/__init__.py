"""Column functions: JVM expressions only."""
