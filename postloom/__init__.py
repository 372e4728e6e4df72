"""Social-post analytics as DataFrame functions on Spark."""
