"""Column expressions: text, time and score functions, all evaluated in the JVM."""
