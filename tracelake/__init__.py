"""Event-correlation analytics for Spark."""
