"""Usage audit of registered components as Spark DataFrame jobs."""
