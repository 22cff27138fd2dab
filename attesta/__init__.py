"""Record and document verification as Spark DataFrame functions."""
