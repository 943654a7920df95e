"""Event-time analytics on Spark: one DataFrame function per operator."""
