"""Column-level functions (no shuffles, JVM side)."""
