"""railbird: event-log and hand-history analytics as plain Spark jobs."""
