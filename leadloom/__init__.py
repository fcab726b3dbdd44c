"""Company-record analytics on Spark."""
