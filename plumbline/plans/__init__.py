"""Multi-step runs that take small decisions on the driver between Spark jobs."""
