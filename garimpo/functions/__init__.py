"""Column functions that stay inside the JVM, and the few Arrow functions that cannot."""
