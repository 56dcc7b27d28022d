"""Score-token analytics on Spark."""
