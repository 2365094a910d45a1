"""Column expressions; everything but MTLD stays inside the JVM."""
