"""docweave: document analytics as plain DataFrame functions on Spark."""
