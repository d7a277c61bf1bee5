"""Practice-run analytics as Spark DataFrame functions."""
