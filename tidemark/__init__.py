"""Cash analytics on Spark."""
