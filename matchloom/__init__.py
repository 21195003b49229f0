"""Match-event analytics on Spark."""
