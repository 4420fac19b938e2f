"""Column-to-column building blocks; everything stays in JVM expressions."""
