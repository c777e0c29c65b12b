"""Evidence-bounded dependency analytics on Spark."""
